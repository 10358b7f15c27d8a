"""What is wrong with a request, as a message; empty if nothing is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECTIONS = ("both", "upstream", "downstream")
RELATION_TYPES = (1, 2)

# fixed values: the messages
BAD_DIRECTION = "direction 仅支持 both/upstream/downstream"
MANY_SEEDS = "branch、functions、query 只能三选一"
NO_MODULE = "源模块与目标模块不能为空"
SAME_MODULE = "源模块与目标模块不能相同"
BAD_TYPE = "relation_type 仅支持 1/2"
NO_CREATOR = "创建人不能为空"


def is_blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def impact_error(direction: Column, branch: Column, functions: Column, query: Column) -> Column:
    """Of a request for an impact: a blank direction means both; of branch, functions (an array) and query one may be given."""
    given = (~is_blank(branch)).cast("int") + (F.coalesce(F.size(functions), F.lit(0)) > 0).cast("int") + (~is_blank(query)).cast("int")
    return F.when(~is_blank(direction) & ~direction.isin(*DIRECTIONS), BAD_DIRECTION).when(given > 1, MANY_SEEDS).otherwise("")


def relation_error(source: Column, target: Column, relation_type: Column, creator: Column) -> Column:
    """Of a relation that is drawn by hand: the first thing wrong with it."""
    return (
        F.when(is_blank(source) | is_blank(target), NO_MODULE).when(F.trim(source) == F.trim(target), SAME_MODULE)
        .when(~F.coalesce(relation_type.isin(*RELATION_TYPES), F.lit(False)), BAD_TYPE).when(is_blank(creator), NO_CREATOR).otherwise("")
    )
