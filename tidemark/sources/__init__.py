"""Readers: driver tables, fixture views, listings, inventories, catalogs, corpora, configs."""
