"""Expressions and kernels of rotation, quantisation and scoring."""
