"""Reading train/test pairs and writing findings."""

from leakscan.sources.findings import Findings, WrittenFindings, read_findings, write_findings
from leakscan.sources.pair import SplitPair, split_pair
from leakscan.sources.tables import expand_vectors, read_pair

__all__ = ["Findings", "SplitPair", "WrittenFindings", "expand_vectors", "read_findings", "read_pair", "split_pair", "write_findings"]
