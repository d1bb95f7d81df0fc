"""Anonymisation of tables as lazy Spark plans.

The package rewrites columns by declared rules, groups rows into equivalence
classes over quasi-identifiers and applies privacy models on top.  Every
operator takes and returns DataFrames or Columns; those that decide about whole classes
run small jobs as the plan is built.
"""

from veilwright.plans.dispatch import anonymize, report_classes
from veilwright.spec import PrivacyRequest, parse_rules

__all__ = ["PrivacyRequest", "anonymize", "parse_rules", "report_classes"]
