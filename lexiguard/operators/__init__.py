"""Detection, curation, release and evaluation operators over DataFrames."""
