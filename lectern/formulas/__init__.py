"""Formulas: binary equation objects and office markup to MathML and LaTeX."""
