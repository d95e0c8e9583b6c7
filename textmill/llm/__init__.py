"""Operators for preparing training corpora: one module an operator, registered in ``queries``."""
