"""Part of spanforge."""
