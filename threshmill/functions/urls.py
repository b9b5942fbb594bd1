"""URL and host expressions. Operators P1-P6, P16, F4, F5, F23-F26, A21."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts that other organisations' hosts roll up to.
BASELINE = ("cdc.gov", "bls.gov", "osha.gov")
#: Host aliases and the organisation each belongs to.
ORG_ALIASES = {
    "stacks.cdc.gov": "cdc.gov",
    "bankingjournal.aba.com": "aba.com",
    "myimanetwork.imanet.org": "imanet.org",
    "queue.acm.org": "acm.org",
    "cacm.acm.org": "acm.org",
    "dl.acm.org": "acm.org",
    "rpc.cfainstitute.org": "cfainstitute.org",
    "storage.aanp.org": "aanp.org",
    "amplify.asce.org": "asce.org",
    "pubs.asce.org": "asce.org",
    "cedb.asce.org": "asce.org",
    "asmedigitalcollection.asme.org": "asme.org",
    "dl.astm.org": "astm.org",
    "store.astm.org": "astm.org",
    "mcsdocs.astm.org": "astm.org",
    "news.awwa.org": "awwa.org",
    "dl.ashrae.org": "ashrae.org",
    "apps.asha.org": "asha.org",
    "pubs.asha.org": "asha.org",
    "archive.cdc.gov": "cdc.gov",
    "obis.osha.gov": "osha.gov",
    "pmc.ncbi.nlm.nih.gov": "ncbi.nlm.nih.gov",
    "research.aota.org": "aota.org",
}
#: Names of the four source categories.
FEDERAL_BASELINE = "Federal .gov baseline (BLS/OSHA/CDC)"
FEDERAL_OTHER = "Federal .gov (other)"
STATE_BOARDS = "State licensing boards"
ACADEMIC = "Academic / .edu"
SOCIETIES = "Professional societies & associations"
#: Suffixes of state hosts in the first version of the categories.
STATE_SUFFIXES = (".ca.gov", ".tx.gov", ".texas.gov", ".fl.gov", ".ny.gov", ".state.gov")
#: Federal roots of the second version.
FEDERAL_ROOTS = (
    "nih.gov", "fda.gov", "dol.gov", "ssa.gov", "epa.gov", "ftc.gov", "doe.gov", "dot.gov", "faa.gov", "fra.gov", "fmcsa.gov", "fcc.gov", "fbi.gov", "ferc.gov",
    "treasury.gov", "usgs.gov", "nasa.gov", "nrc.gov", "uspto.gov", "uscis.gov", "gao.gov", "noaa.gov", "energy.gov", "labor.gov", "commerce.gov",
    "agriculture.gov", "fdic.gov", "sec.gov", "occ.gov", "cms.gov", "hud.gov", "va.gov", "nist.gov", "ed.gov", "doi.gov",
)
#: Prefixes of vendors' documentation hosts.
VENDOR_PREFIXES = ("docs", "support", "help", "developer", "learn")
#: Hosts of communities.
COMMUNITY_HOSTS = (
    "reddit.com", "stackexchange.com", "stackoverflow.com", "serverfault.com", "superuser.com", "askubuntu.com", "metafilter.com", "quora.com",
    "allnurses.com", "truckersreport.com", "electriciantalk.com", "plumbingzone.com", "plumbersforums.net", "hvac-talk.com", "weldingweb.com",
    "contractortalk.com", "garagejournal.com", "avsforum.com", "ycombinator.com", "bogleheads.org",
)


def host(url: Column) -> Column:
    """Network location in lower case without one leading www.; port and user stay."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1), r"^www\.", "")


def strip_www_run(domain: Column, strict: bool = False) -> Column:
    """Drop every leading w and dot; strict drops the one prefix www. instead."""
    return F.regexp_replace(domain, r"^www\.", "") if strict else F.ltrim(domain, F.lit("w."))


def canonical(url: Column, variant: str = "utm_query") -> Column:
    """utm_query cuts at ?utm_, query at ?, utm_fragment at ?utm and #, utm_source at ?utm_source=openai up to the line's end."""
    if variant == "utm_query":
        return F.regexp_replace(url, r"\?utm_[\s\S]*$", "")
    if variant == "query":
        return F.substring_index(url, "?", 1)
    if variant == "utm_source":
        return F.regexp_replace(url, r"\?utm_source=openai.*", "")
    return F.regexp_replace(F.regexp_replace(url, r"\?utm[\s\S]*$", ""), r"#[\s\S]*$", "")


def under(h: Column, roots: tuple[str, ...]) -> Column:
    """The host is one of the roots or below one: its dotted suffixes are looked up, not compared one by one."""
    pattern = "|".join(r.replace(".", r"\.") for r in roots)
    return h.rlike(rf"(^|\.)({pattern})$")


def organisation(h: Column) -> Column:
    """Baseline hosts by suffix first, then aliases, else the host."""
    out = F.lit(None).cast("string")
    for b in reversed(BASELINE):
        out = F.when((h == b) | h.endswith("." + b), F.lit(b)).otherwise(out)
    aliases = F.create_map(*[F.lit(x) for kv in ORG_ALIASES.items() for x in kv])
    return F.coalesce(out, F.try_element_at(aliases, h), h)


def major_group(soc: Column, merge_health: bool = False) -> Column:
    """P5: text before the first dash, ? if missing; 29 and 31 may count as HEALTH."""
    g = F.when(F.coalesce(soc, F.lit("")) == "", F.lit("?")).otherwise(F.substring_index(soc, "-", 1))
    return F.when(g.isin("29", "31"), F.lit("HEALTH")).otherwise(g) if merge_health else g


def lift_soc(soc: Column) -> Column:
    """A code without a detail suffix gets .00."""
    return F.when(F.instr(soc, ".") > 0, soc).otherwise(F.concat(soc, F.lit(".00")))


def category(h: Column, version: int = 1) -> Column:
    """The source category of a host, in either version."""
    baseline = under(h, BASELINE) if version == 2 else h.isin(*BASELINE)
    if version == 1:
        state = F.lit(False)
        for s in STATE_SUFFIXES:
            state = state | h.endswith(s)
        academic = h.endswith(".edu") | (h == "arxiv.org") | h.rlike(r"ncbi\.nlm\.nih\.gov|biomedcentral\.com|frontiersin\.org|mdpi\.com|biorxiv\.org|medrxiv\.org|europepmc\.org")
        return F.when(baseline, FEDERAL_BASELINE).when(h.endswith(".gov") & state, STATE_BOARDS).when(h.endswith(".gov"), FEDERAL_OTHER).when(academic, ACADEMIC).otherwise(SOCIETIES)
    academic = h.isin("arxiv.org", "doi.org", "ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "pubmed.ncbi.nlm.nih.gov") | h.rlike(r"^(ncbi|pmc|pubmed)\.") | h.endswith(".edu")
    return F.when(baseline, FEDERAL_BASELINE).when(academic, ACADEMIC).when(under(h, FEDERAL_ROOTS), FEDERAL_OTHER).when(h.endswith(".gov"), STATE_BOARDS).otherwise(SOCIETIES)


def is_vendor(h: Column, known: tuple[str, ...] = ()) -> Column:
    """a known vendor or a documentation host below .com."""
    by_name = h.isin(*known) if known else F.lit(False)
    return by_name | h.rlike(rf"^({'|'.join(VENDOR_PREFIXES)})\..*\.com$")


def community_class(h: Column) -> Column:
    """community, authoritative or other."""
    authority = h.rlike(r"\.gov$|\.gov\.|\.mil$|\.edu$|\bwho\.int$|\bservsafe\.com$") | h.endswith(".org")
    return F.when(under(h, COMMUNITY_HOSTS), "community").when(authority, "authoritative").otherwise("other")


def suffixes(h: Column) -> Column:
    """The host and each parent domain, for equi-joins on suffixes."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def paywalled(url: Column) -> Column:
    """F4."""
    return url.rlike(r"ieeexplore\.ieee\.org/iel\d/")


def pmc_id(url: Column) -> Column:
    """The digits of a PMC id, else empty."""
    return F.regexp_extract(url, r"/(?:articles/)?PMC(\d+)", 1)


def platform(url: Column) -> Column:
    """forum platform of a URL."""
    return F.when(url.contains("reddit.com"), "reddit").when(url.rlike(r"stackexchange\.com|stackoverflow\.com|serverfault\.com|superuser\.com|askubuntu\.com"), "stackexchange").otherwise("other")


#: Parts of the URLs of questions.
QUESTION_PATHS = (".stackexchange.com/questions/", "stackoverflow.com/questions/", "serverfault.com/questions/", "superuser.com/questions/", "askubuntu.com/questions/")


def is_thread(url: Column) -> Column:
    """reddit or stackexchange if the URL is one of their threads, else null."""
    question = F.lit(False)
    for part in QUESTION_PATHS:
        question = question | F.contains(url, F.lit(part))
    return F.when(F.contains(url, F.lit("reddit.com/r/")) & F.contains(url, F.lit("/comments/")), "reddit").when(question, "stackexchange")


def board(url: Column) -> Column:
    """the board that a forum URL is in, as it is written; empty without one. Rows of denied boards go by an anti join on it."""
    return F.regexp_extract(url, r"reddit\.com/r/([^/]+)/", 1)
