"""sparkcorpus: batch jobs over document corpora as Spark DataFrames."""
