"""terravane: raster, vector and soil-survey analytics declared as Spark DataFrame plans."""
