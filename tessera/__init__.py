"""tessera: dataset curation and classifier evaluation on Spark DataFrames."""
