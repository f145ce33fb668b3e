"""Operations of a training-data pipeline: one module for each, with their registered queries in ``queries``."""
