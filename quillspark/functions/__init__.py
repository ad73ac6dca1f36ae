"""Part of the analytics library; see README.md."""
