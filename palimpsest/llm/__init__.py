"""Operations for large training-data pipelines."""
