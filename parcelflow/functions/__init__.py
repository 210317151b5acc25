"""Part of parcelflow; see the package docstring."""
