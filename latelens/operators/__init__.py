"""Reusable DataFrame constructions that stay distributed under skew."""
