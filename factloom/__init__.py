"""Table facts from Markdown reports, and batched retrieval over them."""

from factloom.operators.facts import extract_facts
from factloom.plans.answering import answer_lookups, plan_lookups
from factloom.plans.knowledge_base import build_facts, build_index

__all__ = ["answer_lookups", "build_facts", "build_index", "extract_facts", "plan_lookups"]
