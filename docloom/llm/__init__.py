"""Operations of a training-data pipeline, each a Spark job over a whole table."""
