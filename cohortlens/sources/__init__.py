from .fixtures import Snowflake, load_snowflake  # noqa: F401
from .readers import (  # noqa: F401
    jdbc_options,
    read_jdbc_predicates,
    read_jdbc_table,
    read_rates_csv,
    snowflake_from_jdbc,
    table_overview,
)
