"""Every query of the library's own operators, and the SQL for those that SQL can express."""

from marlstone.plans import book, market, models, queries, research

QUERIES = {**queries.QUERIES, **book.QUERIES, **market.QUERIES, **models.QUERIES, **research.QUERIES}
SQL = {**queries.SQL, **book.SQL, **market.SQL, **models.SQL, **research.SQL}
