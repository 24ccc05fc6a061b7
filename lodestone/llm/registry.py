"""The registered queries of this subpackage and their SQL."""

from lodestone.llm import queries as _queries
from lodestone.llm import sql as _sql


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_sql.ORACLES)
