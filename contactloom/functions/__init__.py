"""Part of contactloom."""
