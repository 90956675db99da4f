"""Views over the driver's tables that stand in for molecule files, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MOLECULES = """(0,'C'),(1,'CCO'),(2,'CC(=O)O'),(3,'c1ccccc1'),(4,'Cc1ccccc1'),(5,'C1CCCCC1'),(6,'CC#N'),(7,'C=C'),
 (8,'N'),(9,'O'),(10,'CCN(CC)CC'),(11,'OCC(O)CO'),(12,'c1ccncc1'),(13,'c1ccsc1'),(14,'C[C@H](N)C(=O)O'),(15,'[O-]C(=O)C'),
 (16,'[NH4+]'),(17,'C[N+](C)(C)C'),(18,'ClCCl'),(19,'BrCCBr'),(20,'F/C=C/F'),(21,'C1CC1C2CC2'),(22,'[SiH4]'),(23,'C1CC')"""

_VIEWS = {
    "v_mol": (
        "part",
        f"""select p_partkey as mol_id,
       smi || case when p_size % 7 = 0 then '.[Na+]' when p_size % 11 = 0 then '>O' when p_size % 13 = 0 then '(' else '' end as smiles,
       p_brand as source
from part join (select * from (values {_MOLECULES}) as t(k, smi)) base on p_partkey % 24 = k""",
    ),
    "v_seq": (
        "documents",
        "select doc_id as seq_id, substr(upper(regexp_replace(text, '[^A-Za-z]', ''{g})), 1, cast(1 + doc_id % 600 as int)) as seq from documents",
    ),
    "v_atom": (
        "embeddings",
        """select label as complex_id, case when vec_id % 5 = 0 then 'lig' else 'rec' end as entity, vec_id as atom_id,
       case when vec_id % 2 = 0 then 'A' else 'B' end as chain, cast(vec_id % 40 as int) as resnum,
       substr('ALAARGASNASPCYSGLNGLUGLYHISILELEULYSMETPHEPROSERTHRTRPTYRVALMSEHOH', cast(1 + 3 * ((vec_id % 40) % 22) as int), 3) as resname,
       cast(embedding[{0}] as double) as x, cast(embedding[{1}] as double) as y, cast(embedding[{2}] as double) as z
from embeddings""",
    ),
    "v_types": (
        "lineitem",
        """select l_orderkey as file_no, l_linenumber as line_no, l_partkey, l_suppkey,
  case when l_linenumber % 7 = 0 then '# comment'
       when l_linenumber % 3 = 0 then concat_ws(' ', '1', '0.5', cast(l_quantity as varchar(20)), concat('P', cast(l_suppkey as varchar(20)), '_rec_', cast(l_partkey % 50 as varchar(20))), concat('P', cast(l_suppkey as varchar(20)), '_lig_', cast(l_linenumber as varchar(20))))
       when l_linenumber % 2 = 0 then concat_ws(' ', '1', '0.0000', cast(l_quantity as varchar(20)), concat('P', cast(l_suppkey as varchar(20)), '_rec_', cast(l_partkey % 50 as varchar(20)), '.gninatypes'), concat('P', cast(l_suppkey as varchar(20)), '_lig_', cast(l_linenumber as varchar(20)), '.gninatypes'))
       else concat_ws(' ', '1', cast(l_quantity as varchar(20)), concat('P', cast(l_suppkey as varchar(20)), '/r', cast(l_partkey % 50 as varchar(20)), '_rec_0.gninatypes'), concat('P', cast(l_suppkey as varchar(20)), '/l', cast(l_linenumber as varchar(20)), '_lig_0.gninatypes')) end as line
from lineitem""",
    ),
    "v_metric": (
        "events",
        """select user_id as run_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as step,
       value as loss, value / cast(10 as double) as grad_norm, event_type as phase, ts
from events where value is not null""",
    ),
    "v_logit": ("events", "select cast(user_id as bigint) as q, event_id as tok, value / cast(20 as double) as logit from events where value is not null"),
    "v_prop": (
        "part",
        """select p_partkey as mol_id, p_retailprice / cast(2.5 as double) as mw, cast(p_size - 10 as double) / 6 as logp,
       p_partkey % 9 as hbd, p_partkey % 14 as hba, cast(p_partkey % 100 as double) / 100 as qed,
       1 + cast(p_partkey % 90 as double) / 10 as sa
from part""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = _VIEWS[name]
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    text = sql.replace("{g}", "").replace("{0}", "0").replace("{1}", "1").replace("{2}", "2")
    # {frame} binds the DataFrame itself, so that no session-wide view is made
    head, _, tail = text.rpartition(f"from {table}")
    return spark.sql(head + "from {frame} as " + table + tail, frame=frame)


def duck(name: str) -> str:
    """The view as a DuckDB common table expression."""
    sql = _VIEWS[name][1].replace("{g}", ", 'g'").replace("{0}", "1").replace("{1}", "2").replace("{2}", "3")
    return f"{name} as ({sql})"


def with_views(names: str, sql: str) -> str:
    """``sql``, which may begin with "with", after the named views."""
    sql = sql.strip()
    rest = f", {sql[5:]}" if sql.lower().startswith("with ") else f" {sql}"
    return "with " + ", ".join(duck(n) for n in names.split()) + rest
