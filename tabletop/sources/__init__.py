from tabletop.sources.documents import document_column, read_documents
from tabletop.sources.files import read_csv, read_json
from tabletop.sources.jdbc import attach, read_query, read_table
from tabletop.sources.schema import create_table, infer_schema
from tabletop.sources.workbooks import parse_workbooks, read_workbooks

__all__ = [
    "attach",
    "create_table",
    "document_column",
    "infer_schema",
    "parse_workbooks",
    "read_csv",
    "read_documents",
    "read_json",
    "read_query",
    "read_table",
    "read_workbooks",
]
