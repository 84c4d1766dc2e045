"""Request path parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed pattern: one path element.
PATH_ELEMENT = "/([^/]+)"
# Fixed pattern: an API version. \z, unlike $, does not accept a trailing newline.
API_VERSION = r"^[0-9]+([.][0-9]+)?\z"


def path_elements(uri: Column) -> Column:
    """Non-empty path elements; a query string or fragment stays in the last one."""
    return F.regexp_extract_all(uri, F.lit(PATH_ELEMENT), F.lit(1))


def path_element(elements: Column, index: int | Column) -> Column:
    """Element at a 0-based index, null past the end."""
    return F.get(elements, F.lit(index) if isinstance(index, int) else index)


def is_api_version(element: Column) -> Column:
    return F.coalesce(element.rlike(API_VERSION), F.lit(False))
