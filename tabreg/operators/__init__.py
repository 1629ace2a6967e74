"""Row and column operators: projections, fitted statistics, preparation, splits."""
