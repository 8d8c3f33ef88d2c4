"""Tessera: statistical cubes (series x territory x year) and table analytics as Spark jobs."""
