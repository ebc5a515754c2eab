"""Helpers that shape plans: shared checkpoints and size-checked broadcasts."""
