"""Policy tables and the per-entity decision.

A policy written in code (rules per tool, destination allowlists per category, a default
action) is compiled into one ``CASE WHEN`` over literal maps, so deciding an action needs
neither a join nor a shuffle of the (large) entity data. ``decide_actions_joined`` takes
the policy as tables of any size and decides by equi-joins; a test holds both to agree.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import fixed as X

TOKENIZE, REDACT, MASK, BLOCK, PASS = "TOKENIZE", "REDACT", "MASK", "BLOCK_TOOL", "PASS_THROUGH"
ACTIONS = [TOKENIZE, REDACT, MASK, BLOCK, PASS]

TYPE_CATEGORY = {t: X.CREDENTIAL for t in X.CREDENTIAL_TYPES}
TYPE_CATEGORY.update({t: X.BUSINESS_CONFIDENTIAL for t in X.BUSINESS_TYPES})
TYPE_CATEGORY.update({t: X.PERSONAL_INFO for t in X.PERSONAL_TYPES})

def normalize_action(action: str) -> str:
    """P2 (Python side, for building policies)."""
    clean = str(action).strip().upper()
    for key, act in (("TOKEN", TOKENIZE), ("REDACT", REDACT), ("MASK", MASK), ("BLOCK", BLOCK)):
        if key in clean:
            return act
    if "PASS" in clean or "ALLOW" in clean:
        return PASS
    return TOKENIZE


def normalize_action_col(action: Column) -> Column:
    """P2 as a column expression."""
    a = F.upper(F.trim(action))
    return (
        F.when(a.contains("TOKEN"), F.lit(TOKENIZE))
        .when(a.contains("REDACT"), F.lit(REDACT))
        .when(a.contains("MASK"), F.lit(MASK))
        .when(a.contains("BLOCK"), F.lit(BLOCK))
        .when(a.contains("PASS") | a.contains("ALLOW"), F.lit(PASS))
        .otherwise(F.lit(TOKENIZE))
    )


def normalize_type(name: str) -> str:
    """D3 (Python side)."""
    clean = str(name).strip().upper()
    return X.TYPE_ALIASES.get(clean, clean)


def _lit_map(d: dict) -> Column:
    if not d:
        return F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def normalize_type_col(name: Column) -> Column:
    """D3 as a column expression: alias map lookup, unknown names kept (trimmed, upper)."""
    clean = F.upper(F.trim(name))
    return F.coalesce(F.element_at(_lit_map(X.TYPE_ALIASES), clean), clean)


def category_col(pii_type: Column, own_category: Column | None = None) -> Column:
    """Fixed type -> category map wins over the detector's own category; default PERSONAL_INFO."""
    own = own_category if own_category is not None else F.lit(None).cast("string")
    return F.coalesce(F.element_at(_lit_map(TYPE_CATEGORY), pii_type), own, F.lit(X.PERSONAL_INFO))


def is_strict(pii_type: Column) -> Column:
    """B8."""
    return pii_type.isin(*X.STRICT_TYPES)


@dataclass
class ToolRule:
    tool: str
    actions: dict[str, str] = field(default_factory=dict)
    blocked: set[str] = field(default_factory=set)
    whitelisted_fields: set[str] = field(default_factory=set)
    credential_exceptions: set[str] = field(default_factory=set)


@dataclass
class Policy:
    default_action: str = TOKENIZE
    rules: dict[str, ToolRule] = field(default_factory=dict)
    allowlists: dict[str, set[str]] = field(
        default_factory=lambda: {k: set(v) for k, v in X.DEFAULT_ALLOWLISTS.items()}
    )
    simple_redaction: bool = False

    # ---- building (P3, A7, D4) ----
    def set_rule(self, pii_type: str, action: str, tool: str = "*") -> "Policy":
        """Set one action for a tool (or ``*``); names go through the alias map."""
        rule = self.rules.setdefault(tool, ToolRule(tool))
        rule.actions[normalize_type(pii_type)] = normalize_action(action)
        return self

    def add_rule(self, rule: ToolRule) -> "Policy":
        """Replace a whole tool rule."""
        rule.actions = {normalize_type(k): normalize_action(v) for k, v in rule.actions.items()}
        self.rules[rule.tool] = rule
        return self

    def load_rules(self, rules, tool: str = "*") -> "Policy":
        """``{"PII_RULES": {...}}`` or a flat map, as dict or JSON text; bad JSON -> no rules.

        Rules are loaded under ``tool`` (our fix of Q4: the scope is honoured).
        """
        data = rules
        if isinstance(data, str):
            try:
                data = json.loads(data)
            except Exception:
                return self
        table = data.get("PII_RULES", data) if isinstance(data, dict) else {}
        if not isinstance(table, dict):
            return self
        for name, act in table.items():
            self.set_rule(name, act, tool)
        return self

    def authorize(self, category: str, tool: str) -> "Policy":
        """Allow a destination for a category."""
        self.allowlists.setdefault(category, set()).add(tool)
        return self

    @classmethod
    def default_backend(cls, tool: str = "*", default_action: str = TOKENIZE, simple_redaction: bool = True) -> "Policy":
        return cls(default_action=default_action, simple_redaction=simple_redaction).load_rules(
            {"PII_RULES": X.DEFAULT_RULES}, tool
        )

    # ---- decision (P1) ----
    def authorized_col(self, category: str, tool: Column) -> Column:
        allowed = sorted(self.allowlists.get(category, set()))
        if "*" in allowed:
            return F.lit(True)
        if not allowed:
            return F.lit(False)
        return tool.isin(*allowed)

    def action_col(self, tool: Column, pii_type: Column, field_name: Column | None = None,
                   own_category: Column | None = None) -> Column:
        """The ordered decision of one entity as a single CASE WHEN.

        whitelisted field -> PASS; blocked type -> BLOCK; credential: exception -> rule action
        (default REDACT), authorised gateway -> rule action or default, strict -> BLOCK, named tool
        without explicit action -> BLOCK; business: unauthorised -> BLOCK, else rule action or
        default; then rule action; then default. A tool's rule replaces the ``*`` rule (Q3).
        """
        field_name = field_name if field_name is not None else F.lit(None).cast("string")
        cat = category_col(pii_type, own_category)
        has_tool_rule = tool.isin(*self.rules.keys()) if self.rules else F.lit(False)
        has_star = "*" in self.rules

        # effective rule key: tool if it has a rule, else '*' if present, else null
        rule_key = F.when(has_tool_rule, tool)
        if has_star:
            rule_key = rule_key.otherwise(F.lit("*"))
        # (rule, type) -> action ; rule -> arrays
        act_map = _lit_map({f"{t}\u0001{ty}": a for t, r in self.rules.items() for ty, a in r.actions.items()})
        rule_action = F.element_at(act_map, F.concat(rule_key, F.lit("\u0001"), pii_type))

        def set_member(attr: str, value: Column) -> Column:
            pairs = {f"{t}\u0001{v}": "1" for t, r in self.rules.items() for v in getattr(r, attr)}
            if not pairs:
                return F.lit(False)
            return F.element_at(_lit_map(pairs), F.concat(rule_key, F.lit("\u0001"), value)).isNotNull()

        whitelisted = F.coalesce(set_member("whitelisted_fields", field_name), F.lit(False))
        blocked = F.coalesce(set_member("blocked", pii_type), F.lit(False))
        exception = F.coalesce(set_member("credential_exceptions", pii_type), F.lit(False))
        default = F.lit(self.default_action)
        cred_auth = self.authorized_col(X.CREDENTIAL, tool)
        biz_auth = self.authorized_col(X.BUSINESS_CONFIDENTIAL, tool)
        is_cred = cat == X.CREDENTIAL
        is_biz = cat == X.BUSINESS_CONFIDENTIAL
        return (
            F.when(whitelisted, F.lit(PASS))
            .when(blocked, F.lit(BLOCK))
            .when(is_cred & exception, F.coalesce(rule_action, F.lit(REDACT)))
            .when(is_cred & cred_auth, F.coalesce(rule_action, default))
            .when(is_cred & is_strict(pii_type), F.lit(BLOCK))
            .when(is_cred & (tool != "*") & rule_action.isNull(), F.lit(BLOCK))
            .when(is_biz & ~biz_auth, F.lit(BLOCK))
            .otherwise(F.coalesce(rule_action, default))
        )


def dim_type(spark: SparkSession) -> DataFrame:
    """Dimension table ``dim_type(pii_type, category, strict)`` (46 rows)."""
    rows = [(t, TYPE_CATEGORY[t], t in X.STRICT_TYPES) for t in X.ALL_TYPES]
    return spark.createDataFrame(rows, "pii_type string, category string, strict boolean")


RULES = "tool string, type_name string, action string, version long, item long"
#: The version of the built-in rules: below all others.
BUILT_IN = -1


def default_rules(spark: SparkSession, tool: str = "*") -> DataFrame:
    """The built-in rules as a table, at the lowest version."""
    return spark.createDataFrame([(tool, normalize_type(k), normalize_action(a), BUILT_IN, i) for i, (k, a) in enumerate(X.DEFAULT_RULES.items())], RULES)


def read_rules(spark: SparkSession, path: str, tool: str = "*", version: int = 0, with_defaults: bool = False) -> DataFrame:
    """Rules files (``PII_RULES`` object or flat map) -> rows RULES, in the order of the file.

    A file that can't be read as JSON, or that isn't there, has no rules. ``with_defaults`` puts the built-in ones
    beneath: they hold where no file says otherwise.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    if found is None or not len(found):
        rules = spark.createDataFrame([], RULES)
    else:
        raw = spark.read.text(path, wholetext=True)
        pairs = T.MapType(T.StringType(), T.StringType())
        m = F.coalesce(F.from_json(F.get_json_object("value", "$.PII_RULES"), pairs), F.from_json("value", pairs))
        rules = raw.select(F.posexplode(F.map_entries(m)).alias("item", "kv")).filter("kv.value is not null").select(
            F.lit(tool).alias("tool"), normalize_type_col(F.col("kv.key")).alias("type_name"), normalize_action_col(F.col("kv.value")).alias("action"),
            F.lit(version).cast("long").alias("version"), F.col("item").cast("long").alias("item"))
    return default_rules(spark, tool).unionByName(rules) if with_defaults else rules


def upsert_rules(rules: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` (tool, type_name, action in any spelling, item) as the next version of ``rules``: what they name is
    set, all else stays. Older versions are kept, ``current_rules`` looks through them."""
    newest = rules.agg(F.max("version")).first()[0]
    item = F.col("item") if "item" in updates.columns else F.lit(0)
    return rules.unionByName(updates.select(
        "tool", normalize_type_col(F.col("type_name")).alias("type_name"), normalize_action_col(F.col("action")).alias("action"),
        F.lit(BUILT_IN if newest is None else newest + 1).cast("long").alias("version"), item.cast("long").alias("item")))


def replace_rules(rules: DataFrame, updates: DataFrame) -> DataFrame:
    """The tools named in ``updates`` get these rules and no others (whole rules are replaced)."""
    return upsert_rules(rules.join(updates.select("tool").distinct(), "tool", "left_anti").select(*rules.columns), updates)


def current_rules(rules: DataFrame) -> DataFrame:
    """One action per tool and type: that of the highest version, within it of the last item, and if those
    are equal too the strictest one (block, redact, mask, tokenise, pass)."""
    rank = F.array_position(F.array(*[F.lit(a) for a in (BLOCK, REDACT, MASK, TOKENIZE, PASS)]), F.col("action"))
    newest = Window.partitionBy("tool", "type_name").orderBy(F.desc("version"), F.desc("item"), rank)
    return rules.withColumn("__nth", F.row_number().over(newest)).filter("__nth = 1").select("tool", "type_name", "action")


def decide_actions_df(entities: DataFrame, tool_col: str, policy: Policy, field_col: str | None = None) -> DataFrame:
    """P1 on an entity table via the compiled expression (narrow, no join)."""
    fc = F.col(field_col) if field_col else None
    return entities.withColumn(
        "category", category_col(F.col("pii_type"), F.col("category"))
    ).withColumn("action", policy.action_col(F.col(tool_col), F.col("pii_type"), fc, F.col("category")))


def decide_actions_joined(
    entities: DataFrame,
    tool_col: str,
    policy_rules: DataFrame,
    tool_rules: DataFrame,
    allowlist: DataFrame,
    field_col: str | None = None,
    default_action: str = TOKENIZE,
) -> DataFrame:
    """P1 with the policy as tables of any size: equi-joins only, on the rule that holds (D2), the
    rule's action, blocked types, whitelisted fields, credential exceptions (D5) and the allowlist (D4).

    ``policy_rules``: tool, type_name, action, and version and item if rules may conflict (see
    ``current_rules``). ``tool_rules``: tool, blocked, whitelisted_fields, credential_exceptions (arrays).
    ``allowlist``: category, destination. Agrees with ``Policy``.

    The tables are collapsed to one row per tool (its actions as a map, its sets as arrays: bounded by the types
    and fields there are), so the entities meet them in one join by tool. The rules of ``*`` and the categories open to
    all are one row, which is broadcast.
    """
    none = lambda kind: F.array().cast(kind)
    rules = policy_rules.select("tool", normalize_type_col(F.col("type_name")).alias("type_name"), normalize_action_col(F.col("action")).alias("action"),
                                *[(F.col(c) if c in policy_rules.columns else F.lit(0)).cast("long").alias(c) for c in ("version", "item")])
    actions = current_rules(rules).groupBy("tool").agg(F.map_from_entries(F.collect_list(F.struct("type_name", "action"))).alias("actions"))
    types = lambda c: F.transform(F.coalesce(c, none("array<string>")), normalize_type_col)
    sets = tool_rules.groupBy("tool").agg(
        types(F.flatten(F.collect_list("blocked"))).alias("blocked"), types(F.flatten(F.collect_list("credential_exceptions"))).alias("exceptions"),
        F.flatten(F.collect_list("whitelisted_fields")).alias("white"))
    per_tool = actions.join(sets, "tool", "full").select("tool", F.struct("actions", "blocked", "exceptions", "white").alias("rule"))
    star = per_tool.filter("tool = '*'").select("tool", F.col("rule").alias("__star"))
    free = allowlist.filter("destination = '*'").groupBy(F.col("destination").alias("tool")).agg(F.collect_set("category").alias("__open"))
    for_all = star.join(free, "tool", "full").withColumnRenamed("tool", "__any")
    named = allowlist.groupBy(F.col("destination").alias("__tool")).agg(F.collect_set("category").alias("__named"))

    kind = F.col("pii_type")
    e = entities.withColumn("category", category_col(kind, F.col("category"))).withColumn("__tool", F.col(tool_col))
    e = e.withColumn("__field", F.col(field_col) if field_col else F.lit(None).cast("string"))
    tools = per_tool.select(F.col("tool").alias("__tool"), F.col("rule").alias("__own")).join(named, "__tool", "full")
    e = e.join(tools, "__tool", "left").withColumn("__any", F.lit("*")).join(F.broadcast(for_all), "__any", "left")
    e = e.withColumn("__rule", F.coalesce("__own", "__star"))
    has = lambda arr, v: F.coalesce(F.array_contains(F.col(arr), v), F.lit(False))
    act, category, default = F.element_at(F.col("__rule.actions"), kind), F.col("category"), F.lit(default_action)
    authorised = has("__open", category) | has("__named", category)
    cred, biz = category == X.CREDENTIAL, category == X.BUSINESS_CONFIDENTIAL
    decided = (
        F.when(has("__rule.white", F.col("__field")), F.lit(PASS)).when(has("__rule.blocked", kind), F.lit(BLOCK))
        .when(cred & has("__rule.exceptions", kind), F.coalesce(act, F.lit(REDACT)))
        .when(cred & authorised, F.coalesce(act, default))
        .when(cred & (is_strict(kind) | ((F.col("__tool") != "*") & act.isNull())), F.lit(BLOCK))
        .when(biz & ~authorised, F.lit(BLOCK))
        .otherwise(F.coalesce(act, default))
    )
    return e.withColumn("action", decided).select(*dict.fromkeys([*entities.columns, "category"]), "action")
