"""Operations of a large-scale training-data pipeline, one module per operator.

Nothing outside this folder imports it. ``llm.queries`` registers the
queries; every operator keeps a general interface of its own.
"""
