"""Training-data operators: ten stages that turn raw documents into a training corpus.

Nothing outside this package imports it.
"""
