"""Row rules on streams."""
