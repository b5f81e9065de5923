"""Where triples come from: N-Triples text, DataFrames, relational tables seen as a graph, and the partitioned store."""

from .base import DataFrameSource, Source
from .mapped import MappedSource, Mapping
from .ntriples import read_ntriples, write_ntriples
from .store import Store

__all__ = ["DataFrameSource", "MappedSource", "Mapping", "Source", "Store", "read_ntriples", "write_ntriples"]
