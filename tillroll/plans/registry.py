"""All registered keys and their oracle SQL."""

from tillroll.plans.described import DESCRIBED
from tillroll.plans.named import NAMED
from tillroll.plans.oracle import ORACLE
from tillroll.plans.oracle_described import ORACLE_DESCRIBED

QUERIES = {}
QUERIES.update(NAMED)
QUERIES.update(DESCRIBED)

ORACLE_SQL = {k: v for k, v in {**ORACLE, **ORACLE_DESCRIBED}.items() if k in QUERIES}
