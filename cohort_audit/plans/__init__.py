"""The audit as a whole: configuration gate, sections, flags, recommendation."""
