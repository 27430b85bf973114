"""tabsleuth.plans."""
