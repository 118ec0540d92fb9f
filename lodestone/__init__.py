"""Part of the lodestone engine."""
