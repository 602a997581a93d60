"""textdex: text search, indexing and corpus statistics on PySpark DataFrames."""

from textdex.corpus import Corpus
from textdex.plans.compile import compile
from textdex.plans.pattern import Options, PatternError
from textdex.session import load, shared_dir, ship

__all__ = ["Corpus", "Options", "PatternError", "compile", "load", "shared_dir", "ship"]
