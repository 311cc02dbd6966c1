"""Candidate screening and sequence-catalogue analytics on Spark DataFrames."""

from siftline.session import get_session, materialise, shared_dir

__all__ = ["get_session", "materialise", "shared_dir"]
