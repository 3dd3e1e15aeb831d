"""Operations of a training-data pipeline over text documents. Nothing else in the library imports this package."""
