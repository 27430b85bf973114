"""tabsleuth.operators."""
