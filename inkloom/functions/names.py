"""Rules about names as Column expressions: what a name is, what an alias is worth, an entry's normal form, the roots of titles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.aliases import bare

#: Aliases of each kind of entity that name nothing, and what may stand before them.
BLOCKED = {
    "special_existences": ("鬼", "厉鬼", "恶鬼", "怪物", "存在", "灵异存在", "疑似灵异存在", "老人", "照片", "尸体", "黑影", "影子"),
    "origanizations": ("组织", "公司", "势力", "阵营", "团队", "机构", "部门", "分部"),
    "world_rules": ("规则", "规律", "法则", "设定"),
    "characters": (
        "鬼", "人", "他", "她", "它", "老人", "老人家", "年轻人", "女人", "男人", "小孩", "孩子", "学生", "同学", "老师", "教授", "队长", "负责人", "老板", "店老板", "司机", "售货员", "青年", "少女", "少年",
        "父亲", "母亲", "儿子", "女儿", "那个人", "那只鬼", "那个老人", "黑影", "一个女生", "一个同学", "一个男人", "一个女人", "一个学生", "一个青年", "一个年轻人", "一个老人", "一个小孩", "一个孩子", "小年轻", "同伴",
        "伙伴", "光头壮汉", "光头", "青年男子", "青年女人", "青年女子", "年轻男子", "年轻女子", "中年男人", "中年女人", "壮汉", "女生", "男生", "妈妈", "爸爸", "叔叔", "婶婶", "阿姨", "伯父", "伯母", "舅舅", "姑妈",
        "老板娘", "护士长", "医生", "主治医生",
    ),
}
BLOCKED_PATTERNS = {
    "special_existences": "^(?:那|那个|这|这个|一只|那只|这只|某个|某只|一种|一个)?(?:鬼|厉鬼|恶鬼|怪物|存在|灵异存在|老人|照片|尸体|黑影|影子)$",
    "origanizations": "^(?:某个|这个|那个|一家|一支|一个)?(?:组织|公司|势力|阵营|团队|机构|部门|分部)$",
    "world_rules": "^(?:这个|那个|该|这种|那种|一种)?(?:规则|规律|法则|设定)$",
    "characters": "^(?:那|那个|这|这个|一名|一位|某个|某位|那位|这位|那只|这只|一个)?(?:鬼|人|老人|年轻人|女人|男人|小孩|孩子|学生|同学|老师|教授|队长|负责人|老板|司机|售货员|青年|少女|少年|同伴|伙伴|小年轻|光头|壮汉|光头壮汉|女生|男生|青年男子|青年女子|年轻男子|年轻女子|中年男人|中年女人)$",
}
#: What is cut from an alias's beginning, and the nouns before which 的 is left out.
PREFIXES = {
    "special_existences": "^(?:那个|这个|那只|这只|一只|一个|一种|某个|某只)+",
    "origanizations": "^(?:那个|这个|某个|一家|一支|一个)+",
    "world_rules": "^(?:这个|那个|这种|那种|一种|该)+",
    "characters": "^(?:那个|这个|那只|这只|一只|一个|一名|一位|某个|某位|那名|这名)+",
}
DE_NOUNS = {
    "special_existences": ("鬼", "鬼婴", "鬼影", "影子", "尸体", "老人", "照片", "怪物"),
    "origanizations": ("公司", "组织", "势力", "阵营", "团队", "机构", "部门", "分部", "负责人", "老板", "店长", "店老板", "集团", "俱乐部", "商会", "协会", "联盟"),
    "world_rules": ("规则", "规律", "法则", "设定", "限制", "能力"),
    "characters": (),
}
#: Relations and titles that stand for a person, what nicknames begin with, what descriptions end in, and titles after names.
RELATIONS = ("妈妈", "爸爸", "父亲", "母亲", "叔叔", "婶婶", "阿姨", "伯父", "伯母", "舅舅", "姑妈", "哥哥", "姐姐", "弟弟", "妹妹", "师兄", "师姐", "老板", "老板娘", "护士长", "医生", "主治医生", "主任", "校长", "老师", "教授", "会长", "主席", "家主")
NICKNAMES = ("小", "老", "阿")
DESCRIPTIONS = ("孩子", "男孩", "女孩", "女人", "男人", "秘书", "女秘书", "老板", "老板娘", "经理", "护士", "研究人员", "客人", "大副", "女王")
HONORIFICS = ("先生", "太太", "小姐", "夫人", "女士", "少爷", "老爷")
TITLES = (*HONORIFICS, "公主", "命", "家主", "研究员", "董事长", "姓男生", "姓女生", "姓男孩", "姓女孩", "会长", "部长", "所长", "经理", "副所长", "少校", "中队长", "副中队长", "勋爵", "医生", "大夫")
#: The words that tie a name to another one, and how the other one is quoted.
BRIDGES = ("改名为", "改叫", "又叫", "也叫", "叫做", "名为", "本名为", "称为", "自称", "代号", "就是", "即")
BRIDGE_QUOTES = {"": "", "“": "”", "'": "'"}
QUOTES = "\"'`“”‘’"


def tight(text: Column) -> Column:
    """A text without any blanks; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def _ends(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("(?:" + "|".join(words) + ")$")


def anchored(text: Column) -> Column:
    """Whether a text describes somebody by somebody else: X的 and a relation or title."""
    clean = tight(text)
    right = F.regexp_replace(clean, "^[^的]*的", "")
    return clean.rlike("^[^的]+的.") & _ends(right, RELATIONS)


def generic(text: Column) -> Column:
    """Whether a name names nobody in particular."""
    clean = tight(text)
    return (clean == "") | ~anchored(clean) & (clean.isin(*BLOCKED["characters"], *RELATIONS) | clean.rlike(BLOCKED_PATTERNS["characters"]))


def nickname(text: Column) -> Column:
    clean = tight(text)
    return ~anchored(clean) & clean.rlike("^(?:" + "|".join(NICKNAMES) + ")")


def specific(text: Column) -> Column:
    """Whether a text looks like somebody's own name."""
    clean = tight(text)
    return ~anchored(clean) & ~nickname(clean) & (F.length(clean) >= 2) & ~_ends(clean, DESCRIPTIONS)


def name_rank(text: Column) -> Column:
    """struct(rank, -length, key): own names come first, then descriptions by others, other texts, nicknames; longer ones first."""
    clean = F.trim(text)
    rank = F.when(specific(clean), 0).when(anchored(clean), 1).when(nickname(clean), 3).otherwise(2)
    return F.struct(rank.alias("rank"), (-F.length(clean)).alias("shorter"), F.lower(tight(clean)).alias("key"))


def sane(text: Column) -> Column:
    """A name without quotes around it; empty for a generic one."""
    clean = bare(F.coalesce(text, F.lit("")), QUOTES)
    return F.when(generic(clean), "").otherwise(clean)


def by_key(names: Column) -> Column:
    """The names of an array without later ones of the same key (blanks and case aside) and without empty ones."""
    keyed = F.transform(names, lambda x: F.struct(F.trim(x).alias("name"), F.lower(tight(x)).alias("key")))
    keep = lambda all_: F.filter(all_, lambda x, i: (x["key"] != "") & (F.array_position(F.transform(all_, lambda y: y["key"]), x["key"]) == i + 1))
    return F.transform(F.transform(F.array(keyed), keep)[0], lambda x: x["name"])


def dropped(kind: str, alias: Column) -> Column:
    """Whether an alias of a kind of entity names nothing."""
    clean = tight(alias)
    return (clean == "") | clean.isin(*BLOCKED[kind]) | clean.rlike(BLOCKED_PATTERNS[kind])


def normal_alias(kind: str, alias: Column) -> Column:
    """An alias without blanks, without what points at it, and without 的 before a noun of its kind; people's descriptions by others stay."""
    clean = tight(alias)
    cut = F.regexp_replace(clean, PREFIXES[kind], "")
    if DE_NOUNS[kind]:
        cut = F.regexp_replace(cut, "^(.+?)的(" + "|".join(sorted(DE_NOUNS[kind], key=len, reverse=True)) + ")$", "$1$2")
    return F.when(anchored(clean), clean).otherwise(cut) if kind == "characters" else cut


def slashed(text: Column) -> Column:
    """The parts of a text between slashes, trimmed; without any the text itself."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(clean, r"\s*[/／]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(clean == "", F.array().cast("array<string>")).when(F.size(parts) > 0, parts).otherwise(F.array(clean))


def normal_entry(kind: str, name: Column, aliases: Column) -> Column:
    """struct(name, aliases) of an entry: names and aliases parted at slashes, those that name nothing left out, the rest normal and distinct; null without any.

    The entry's name is its own if it is among the aliases, else the first of them; a person's is the best ranked.
    """
    own = slashed(name)
    raw = F.array_distinct(F.concat(own, F.flatten(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), slashed))))
    kept = F.array_distinct(F.filter(F.transform(F.filter(raw, lambda x: ~dropped(kind, x)), lambda x: normal_alias(kind, x)), lambda x: x != ""))
    head = F.coalesce(F.get(own, F.lit(0)), F.lit(""))

    def entry(all_: Column) -> Column:
        if kind != "characters":
            normal = normal_alias(kind, head)
            return F.when(F.size(all_) > 0, F.struct(F.when((normal != "") & F.array_contains(all_, normal), normal).otherwise(F.get(all_, F.lit(0))).alias("name"), all_.alias("aliases")))
        known = by_key(F.filter(F.transform(F.concat(F.array(head), all_), sane), lambda x: x != ""))
        best = F.array_min(F.transform(known, lambda x: F.struct(name_rank(x).alias("rank"), x.alias("name"))))["name"]
        chosen = F.coalesce(best, head)
        names = by_key(F.filter(F.transform(F.concat(F.array(chosen), all_), sane), lambda x: x != ""))
        return F.transform(F.array(names), lambda n: F.when(F.size(n) > 0, F.struct(chosen.alias("name"), n.alias("aliases"))))[0]

    return F.transform(F.array(kept), entry)[0]


def root(text: Column, titles: tuple[str, ...] = HONORIFICS) -> Column:
    """A name without the title that ends it (the longest that fits); empty without one."""
    clean = tight(text)
    ends = "|".join(re.escape(t) for t in sorted(titles, key=len, reverse=True))
    # The longest title is the one that leaves the shortest name.
    return F.regexp_extract(clean, f"^(.+?)(?:{ends})$", 1)
