from tillroll.sources.binding import o_return, sales_line, users  # noqa: F401
from tillroll.sources.tables import read_table, register_views  # noqa: F401
