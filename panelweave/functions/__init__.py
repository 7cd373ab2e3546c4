"""Column functions: text, links, dates, bins, lists."""
