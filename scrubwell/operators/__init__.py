"""DataFrame operators; each is usable alone with ``df.transform``."""
