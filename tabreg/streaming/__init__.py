"""Streaming.

The reference pipeline has no streams, watermarks or state. The only streaming use here is that
a fitted preparation and model are plain column expressions plus a Spark ML ``transform``, so the
same objects score a ``readStream`` source unchanged (``scoring.score_stream``).
"""
