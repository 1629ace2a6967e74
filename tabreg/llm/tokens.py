"""Token ids of whole texts by a public tokenizer file, with a memo of words per Python worker.

The tokenizer drops white space and never joins characters across it, so a text's ids are those
of its parts between ASCII white space, one after the other. Words recur, so each worker keeps
the packed ids of those it met lately, in two generations of a fixed size; what has left the memo
is encoded again, so the memo changes nothing but time.
"""

from __future__ import annotations

import os
import re

#: Words in a generation of the memo.
MEMO_WORDS = 500_000

_ENCODERS: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Packed little-endian uint16 ids of texts. Only for tokenizers that drop white space and
    have at most 65,536 ids (``word_bpe_49k.json`` has 49,408)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        if self.whole.get_vocab_size(with_added_tokens=True) > 65_536:
            raise ValueError("WordEncoder packs ids in 16 bits; this vocabulary has more")
        self.model = self.whole.model
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_as_chars: dict[str, str] = {}
        self.memo: dict[bytes, bytes] = {}
        self.old_memo: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.old_cores: dict[str, bytes] = {}
        # letters whose lower case and composed form are the same in every library, then ASCII
        # punctuation but for the apostrophe (which starts contractions)
        self.simple = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

    def _spelled(self, piece: str) -> str:
        """The tokenizer's spelling of a piece's UTF-8 bytes as characters."""
        if piece.isascii():
            return piece
        out = []
        for ch in piece:
            if ch not in self.bytes_as_chars:
                self.bytes_as_chars[ch] = "".join(p for p, _ in self.byte_level.pre_tokenize_str(ch))
            out.append(self.bytes_as_chars[ch])
        return "".join(out)

    def _core(self, piece: str) -> bytes:
        ids = self.cores.get(piece)
        if ids is None:
            ids = self.old_cores.get(piece)
            if ids is None:
                ids = b"".join([t.id.to_bytes(2, "little") for t in self.model.tokenize(self._spelled(piece))])
            self.cores[piece] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if m := self.simple(text):
            return self._core(m[1].lower()) + (self._core(m[2]) if m[2] else b"")
        return b"".join([i.to_bytes(2, "little") for i in self.whole.encode(text, add_special_tokens=False).ids])

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        words = text.split()
        memo, old = self.memo, self.old_memo
        found = list(map(memo.get, words))
        if None in found:
            for at, ids in enumerate(found):
                if ids is None:
                    word = words[at]
                    found[at] = ids = memo.get(word) or old.get(word) or self._word(word)
                    if len(word) <= 64:
                        memo[word] = ids
        if len(memo) > MEMO_WORDS:
            self.memo, self.old_memo = {}, memo
        if len(self.cores) > MEMO_WORDS:
            self.cores, self.old_cores = {}, self.cores
        return b"".join(found)


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
