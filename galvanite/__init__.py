"""Part of the evidence analytics library."""
