"""Part of weftline; see README.md."""
