"""Templates: configuration, registry of processors and hooks, per-document plans.

A processor is a function ``DataFrame -> DataFrame`` registered under a class name; hooks before a
reduction are Column functions, reductions are ``DataFrame -> DataFrame`` over (doc_id, item_name),
and region hooks return several rows a document. Models and pixels plug in as pandas functions of
the same shapes; without one the input passes through."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reduce
from .joins import by_boundary
from .matching import key_distance

PROCESSORS: dict[str, dict[str, Callable]] = {"template": {}, "free": {}, "pages": {}}
HOOKS: dict[str, Callable] = {"max_w_regex": reduce.max_weight, "select_above": reduce.select_above, "select_down": reduce.select_below, "select_max_regex_above": reduce.max_weight_above, "select_max_regex_down": reduce.max_weight_below, "return_1_if_non_empty": reduce.exists_flag}


class ConfigError(ValueError):
    """A configuration names something that does not exist."""


def processor(kind: str, name: str):
    """Registers a processor; a name may be taken once."""

    def add(f):
        if name in PROCESSORS[kind]:
            raise ConfigError(f"{name} is registered twice")
        PROCESSORS[kind][name] = f
        return f

    return add


def hook(name: str):
    def add(f):
        HOOKS[name] = f
        return f

    return add


def bound(item: dict, stage: str) -> Callable | None:
    """The hook that an item's configuration names for ``pre`` or ``post``: a name, or a name with arguments.
    Without one, a hook named after the item; without that, the default reducer for ``post``."""
    conf = item.get(f"item_{stage}_func")
    if conf is None:
        return HOOKS.get(f"{stage}_{item['item_name']}") or (HOOKS["max_w_regex"] if stage == "post" else None)
    name, args = (conf, {}) if isinstance(conf, str) else next(iter(conf.items()))
    if name not in HOOKS:
        raise ConfigError(f"unknown {stage} function {name} of {item['item_name']}")
    return partial(HOOKS[name], **(args or {}))


def merged(conf: dict, default: dict) -> dict:
    """Items over the defaults of the same name, key by key; others as they are."""
    base = {i["item_name"]: i for i in default.get("fg_items", [])}
    return {**default, **conf, "fg_items": [{**base.get(i["item_name"], {}), **i} for i in conf.get("fg_items", [])]}


def load(path: str, default: str | None = None) -> dict:
    """A YAML template, over a file of defaults if one is given."""
    import yaml

    with open(path) as f:
        conf = yaml.safe_load(f)
    if default:
        with open(default) as f:
            conf = merged(conf, yaml.safe_load(f))
    return conf


def rule_tables(spark: SparkSession, conf: dict) -> dict[str, DataFrame]:
    """Rule tables areas, rules and fields of a template; from version 2 on every weight is one."""
    one = conf.get("version", 1) >= 2
    areas, rules, fields = [], [], []
    for k, i in enumerate(conf.get("fg_items", [])):
        fields.append((i["item_name"], i.get("show_name", i["item_name"]), bool(i.get("should_output", True)), k))
        for n, a in enumerate(i.get("filter_areas") or []):
            a = a if isinstance(a, dict) else {"area": a}
            areas.append((i["item_name"], n, *map(float, a["area"]), 1.0 if one else float(a.get("w", 1)), float(a.get("ioo_thresh", 0))))
        for r in i.get("filter_regexs") or []:
            r = r if isinstance(r, dict) else {"regex": r}
            rules.append((i["item_name"], r["regex"], 1.0 if one else float(r.get("w", 1))))
    return {
        "areas": spark.createDataFrame(areas, "item_name string, area_ord int, l double, t double, r double, b double, w double, ioo double"),
        "rules": spark.createDataFrame(rules, "item_name string, pattern string, w double"),
        "fields": spark.createDataFrame(fields, "item_name string, show_name string, should_output boolean, ord int"),
    }


def run_template(nodes: DataFrame, conf: dict) -> DataFrame:
    """Items of every document and field of a template: areas, hooks before, patterns, reduction, defaults."""
    t = rule_tables(nodes.sparkSession, conf)
    passed = reduce.filter_areas(nodes, t["areas"])
    for i in conf.get("fg_items", []):
        if pre := bound(i, "pre"):
            passed = passed.withColumn("text", F.when(F.col("item_name") == i["item_name"], pre(F.col("text"))).otherwise(F.col("text")))
    passed = reduce.filter_regex(passed, t["rules"]).filter("value <> ''").withColumn("w", F.col("area_w") * F.col("regex_w"))
    # the first area that yields anything decides, whatever reduces it
    best = passed.groupBy("doc_id", "item_name").agg(F.min(F.struct(-F.col("area_w"), "area_ord")).alias("_best"))
    passed = passed.join(best, ["doc_id", "item_name"]).filter(F.col("area_ord") == F.col("_best.area_ord"))
    items = None
    for i in conf.get("fg_items", []):
        own = bound(i, "post")(passed.filter(F.col("item_name") == i["item_name"]))
        value = F.col("value") if "value" in own.columns else F.col("text")
        own = own.select("doc_id", "item_name", value.alias("content"), (F.col("score") if "score" in own.columns else F.lit(1.0)).alias("probability"))
        items = own if items is None else items.unionByName(own)
    return reduce.complete_items(items, nodes, t["fields"])


def key_value(nodes: DataFrame, key: str, boundary, edits: int = 0, default: str | None = None, name: str = "value") -> DataFrame:
    """Without a template: the key box with fewest edits, then the first value (by cy) inside its boundary, or the default."""
    keys = reduce.decide_key(key_distance(nodes, key, edits))
    hit = reduce.top_one(by_boundary(keys, nodes, boundary), ["a_doc_id"], F.col("b_top") + F.col("b_bottom"), "b_node_ix")
    out = nodes.select("doc_id").distinct().join(hit.select(F.col("a_doc_id").alias("doc_id"), F.col("b_text").alias("content")), "doc_id", "left")
    return out.select("doc_id", F.lit(name).alias("item_name"), F.coalesce("content", F.lit(default)).alias("content"))


def structure(nodes: DataFrame, routed: DataFrame) -> DataFrame:
    """Runs each class's processor over its documents and unions the items: free processors before templates."""
    out = None
    for name in sorted({*PROCESSORS["free"], *PROCESSORS["template"]}):
        f = PROCESSORS["free"].get(name) or PROCESSORS["template"][name]
        part = f(nodes.join(routed.filter(F.col("class_name") == name).select("doc_id"), "doc_id", "left_semi")).select("doc_id", "item_name", "content").withColumn("class_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# cross-field rules over wide items
def words_or_number(words: Column, number: Column) -> Column:
    """Two fields that fill one another; the one from words wins."""
    return F.coalesce(F.nullif(words, F.lit("")), F.nullif(number, F.lit("")))


def suffix_number(barcode: Column, size: int = 10, mode: int = 0) -> Column:
    """The last ``size`` characters; mode 1 skips the check digit, mode 2 takes the first ones."""
    return F.when(F.lit(mode) == 2, F.substr(barcode, F.lit(1), F.lit(size))).when(F.lit(mode) == 1, F.right(F.substr(barcode, F.lit(1), F.length(barcode) - 1), F.lit(size))).otherwise(F.right(barcode, F.lit(size)))


def null_if_equal(a: Column, b: Column) -> Column:
    return F.nullif(a, b)


def default_if_set(c: Column, value: str) -> Column:
    """Overrides a field that is not empty."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.lit(value)).otherwise(c)


def build_area(c: Column, mark: str = "*") -> Column:
    """The first decimal of a text, or the mark if it holds two of them."""
    n = F.regexp_extract(c, "[0-9]+\\.[0-9]+", 0)
    return F.when(n != "", n).when(F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit(""))) >= 2 * len(mark), F.lit(mark))


def done_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "(?:19|20)[0-9]{2}", 0), F.lit(""))


def ctc_decode(logits: Column, blank: int) -> Column:
    """Best class of each step of array<array<double>>, repeats collapsed, blanks dropped."""
    best = F.transform(logits, lambda s: F.array_position(s, F.array_max(s)).cast("int") - 1)
    prev = F.concat(F.array(F.lit(-1)), F.slice(best, F.lit(1), F.greatest(F.size(best) - 1, F.lit(0))))
    kept = F.filter(F.zip_with(best, prev, lambda a, b: F.when((a != b) & (a != blank), a)), lambda x: x.isNotNull())
    return kept


MODELS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def with_model(df: DataFrame, name: str) -> DataFrame:
    """Applies a model registered under ``name`` (recognition, text class, entities); without one it is an error of the configuration."""
    if name not in MODELS:
        raise ConfigError(f"no model is registered under {name!r}")
    return MODELS[name](df)


def chunks(c: Column, size: int = 126) -> Column:
    """Pieces of ``size`` characters, as models with a limit take them."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(c, i * size + 1, F.lit(size)))).otherwise(F.array())
