"""Scratch tables of the corpus operators."""

from gritstone.sources.scratch import Scratch, let_workers_import, scratch_dir

__all__ = ["Scratch", "let_workers_import", "scratch_dir"]
