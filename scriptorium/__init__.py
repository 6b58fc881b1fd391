"""Corpus-scale document analytics on Spark: DataFrame in, DataFrame out."""

from scriptorium.plans.planner import Plan, Step
from scriptorium.plans.runner import Registry, Run, Stage, TextTransform
from scriptorium.session import build_session
from scriptorium.tables import load

__all__ = ["Plan", "Registry", "Run", "Stage", "Step", "TextTransform", "build_session", "load"]
