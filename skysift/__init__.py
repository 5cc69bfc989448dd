"""Cloud screening of large satellite-scene catalogues as Spark jobs."""
