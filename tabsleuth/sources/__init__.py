"""tabsleuth.sources."""
