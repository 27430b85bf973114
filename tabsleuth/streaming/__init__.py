"""tabsleuth.streaming."""
