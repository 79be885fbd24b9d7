"""Tessera: catalog integration, entity resolution and ranking as Spark plans."""
