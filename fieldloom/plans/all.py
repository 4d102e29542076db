"""All registered queries: importing this module fills the registry."""

from fieldloom.plans import catalogue, catalogue_documents, catalogue_fields
from fieldloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalogue", "catalogue_documents", "catalogue_fields"]
