"""Linting and repair of document-layout blocks on PySpark."""

from layoutlint.operators.detect import detect
from layoutlint.operators.markdown import render
from layoutlint.plans.refine import Refined, assign_ids, refine, strip_ids
from layoutlint.sources.content_lists import items_from_rows, parse_items, read_content_lists, read_images

__all__ = ["Refined", "assign_ids", "detect", "items_from_rows", "parse_items", "read_content_lists", "read_images", "refine", "render", "strip_ids"]
