"""Documents to blocks, chunks, links and answers, as Spark DataFrames."""
