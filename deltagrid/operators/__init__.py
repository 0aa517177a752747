"""DataFrame operators: pyramids, merges, lines, terrain, search, addresses, graphs, audits."""
