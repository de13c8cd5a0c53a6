"""helixspark: DNA-structure motif analytics on Spark DataFrames."""
