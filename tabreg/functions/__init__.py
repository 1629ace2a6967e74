"""Column functions: scores, residuals, text formats."""
