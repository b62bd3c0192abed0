"""lexiwave: language-model, speech-feature and sequence-model analytics on Spark DataFrames."""
