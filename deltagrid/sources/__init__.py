"""Reading and writing map data: names of tiles, layered tables, incremental publishing."""
