"""Driver tables and the customer views derived from them.

Every churn query starts from :func:`customers_raw`, a 21-column customer
table derived from ``customer ⋈ orders ⋈ nation``. The SQL text is shared
with the DuckDB oracle (placeholders ``{customer}``, ``{orders}``,
``{nation}``), so both engines compute the same view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]


_SCANS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table (column pruning and filter pushdown
    happen in Catalyst once the consumer selects and filters). The scan
    DataFrame is reused within a session, so its footer is read once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, id(spark), path)
    if key not in _SCANS:
        _SCANS[key] = spark.read.parquet(path)
    return _SCANS[key]


# Customer view. Charges are derived with integer / decimal arithmetic only,
# which both engines evaluate to the same doubles.
CUSTOMER_VIEW_SQL = """
with o as (
  select o_custkey, count(distinct date_trunc('month', o_orderdate)) as m,
         sum(cast(o_totalprice as decimal(18,2))) as tot, max(o_orderdate) as last_d
  from {orders} group by o_custkey),
b as (select c.c_custkey as k, c.c_name as nm, c.c_mktsegment as seg, n.n_regionkey as rk,
             o.m as m, o.tot as tot, o.last_d as last_d
      from {customer} c join o on o.o_custkey = c.c_custkey join {nation} n on n.n_nationkey = c.c_nationkey)
select nm as customerID,
 case when k % 2 = 0 then 'Male' else 'Female' end as gender,
 case when k % 6 = 0 then 1 else 0 end as SeniorCitizen,
 case when k % 5 < 2 then 'Yes' else 'No' end as Partner,
 case when k % 7 < 2 then 'Yes' else 'No' end as Dependents,
 cast(m as int) as tenure,
 case when k % 10 = 9 then 'No' else 'Yes' end as PhoneService,
 case when k % 10 = 9 then 'No phone service' when k % 3 = 0 then 'Yes' else 'No' end as MultipleLines,
 case when rk in (0,1) then 'DSL' when rk in (2,3) then 'Fiber optic' else 'No' end as InternetService,
 case when rk = 4 then 'No internet service' when k % 4 = 0 then 'Yes' else 'No' end as OnlineSecurity,
 case when rk = 4 then 'No internet service' when k % 3 = 1 then 'Yes' else 'No' end as OnlineBackup,
 case when rk = 4 then 'No internet service' when k % 5 = 0 then 'Yes' else 'No' end as DeviceProtection,
 case when rk = 4 then 'No internet service' when k % 7 = 0 then 'Yes' else 'No' end as TechSupport,
 case when rk = 4 then 'No internet service' when k % 11 < 4 then 'Yes' else 'No' end as StreamingTV,
 case when rk = 4 then 'No internet service' when k % 13 < 5 then 'Yes' else 'No' end as StreamingMovies,
 case when seg in ('AUTOMOBILE','BUILDING','FURNITURE') then 'Month-to-month' when seg = 'HOUSEHOLD' then 'One year' else 'Two year' end as Contract,
 case when k % 8 < 5 then 'Yes' else 'No' end as PaperlessBilling,
 case k % 4 when 0 then 'Electronic check' when 1 then 'Mailed check' when 2 then 'Bank transfer (automatic)' else 'Credit card (automatic)' end as PaymentMethod,
 cast(1800 + k * 37 % 10076 as double) / 100 as MonthlyCharges,
 case when k % 640 = 0 then ' ' else cast(cast(cast(tot as decimal(18,2)) * 0.0002 as decimal(12,2)) as varchar(20)) end as TotalCharges,
 case when last_d < timestamp '2001-01-01 00:00:00' then 'Yes' else 'No' end as Churn
from b
"""

# Dirty variant: a second copy of every 100th customer appended after the
# originals (id padded with a space, blank charges, unmapped label), tab and
# space padding, raw "1"/"0" labels and a few out-of-domain values. The
# customer number is the digits after "Customer#".
DIRTY_VIEW_SQL = """
with t as ({view}),
n as (select t.*, cast(substr(customerID, 10) as bigint) as k from t),
orig as (
  select customerID,
    case when k % 50 = 7 then concat('  ', gender, {tab}) else gender end as gender,
    SeniorCitizen, Partner, Dependents,
    case when k % 97 = 0 then -1 else tenure end as tenure,
    PhoneService, MultipleLines, InternetService, OnlineSecurity, OnlineBackup,
    DeviceProtection, TechSupport, StreamingTV, StreamingMovies,
    case when k % 89 = 0 then 'Quarterly' else Contract end as Contract,
    PaperlessBilling, PaymentMethod,
    case when k % 79 = 0 then 0.0 else MonthlyCharges end as MonthlyCharges,
    TotalCharges,
    case when k % 83 = 0 then (case when Churn = 'Yes' then '1' else '0' end) else Churn end as Churn,
    k as load_order
  from n),
dup as (
  select concat(' ', customerID) as customerID, gender, SeniorCitizen, Partner, Dependents,
    tenure, PhoneService, MultipleLines, InternetService, OnlineSecurity, OnlineBackup,
    DeviceProtection, TechSupport, StreamingTV, StreamingMovies, Contract,
    PaperlessBilling, PaymentMethod, MonthlyCharges, ' ' as TotalCharges,
    'Maybe' as Churn, 1000000000 + k as load_order
  from n where k % 100 = 0)
select * from orig
union all
select * from dup
"""


def customer_view_sql(customer: str = "customer", orders: str = "orders",
                      nation: str = "nation") -> str:
    return CUSTOMER_VIEW_SQL.format(customer=customer, orders=orders, nation=nation)


def dirty_view_sql(view_sql: str, tab: str) -> str:
    return DIRTY_VIEW_SQL.format(view=view_sql, tab=tab)


def customers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw 21-column customer table (TotalCharges and Churn as text)."""
    return spark.sql(
        CUSTOMER_VIEW_SQL,
        customer=table(spark, sf_dir, "customer"),
        orders=table(spark, sf_dir, "orders"),
        nation=table(spark, sf_dir, "nation"),
    )


def customers_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw customers with duplicates, padding and bad values, plus
    ``load_order`` (position in the file; appended copies come last)."""
    return spark.sql(
        dirty_view_sql(CUSTOMER_VIEW_SQL, "char(9)"),
        customer=table(spark, sf_dir, "customer"),
        orders=table(spark, sf_dir, "orders"),
        nation=table(spark, sf_dir, "nation"),
    )


def oracle_customer_view() -> str:
    """DuckDB form of the raw customer view (plain table names)."""
    return customer_view_sql()


def oracle_dirty_view() -> str:
    return dirty_view_sql(customer_view_sql(), "chr(9)")
