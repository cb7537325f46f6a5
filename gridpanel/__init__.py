"""Panel analytics on Spark: drifting report grids in, clean entity x period panels out."""
