"""Operations of a training-data pipeline, on top of the engine."""
