"""tabsleuth.functions."""
