"""Security rules as decision lists of column expressions over a call's context.

The context of a site: ``method``, ``receiver_type``, ``args``, ``settled`` (the first argument's text where
constants settle it, else null), ``ext`` (an operand is outside input), ``tainted`` (one is a
caller's parameter), ``hard_any``/``hard_all`` (literals or constants), ``chain`` (confidence of its taint chain, null
without), ``hardened`` (the receiver, or what made it, was locked down before), ``receiver_ext``/``receiver_tainted`` (what the
receiver was made of), ``names`` (of outside and tainted operands). Each list gives a confidence, or null for no alert. A site
whose rule names no list gets medium; one whose list is not known gets low, so that a broken rule is seen. Users add
checks of their own with ``checks``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.operators.checks import Check, checked


@dataclass
class Rule:
    id: str
    name: str
    severity: str
    globs: list[str]
    description: str = ""
    check: str = ""
    tags: list[str] = field(default_factory=list)
    needs_chain: bool = False


_c = F.col


def _sql() -> Column:
    m, t = _c("method"), _c("receiver_type")
    spread = _c("ext") | _c("chain").isNotNull()
    return (
        F.when(t.contains("PreparedStatement"), None)
        .when(m.isin("createStatement"), F.when(spread, "high").otherwise("medium"))
        .when(t.endswith("Statement"), F.when(spread, "high").when(_c("tainted"), "medium").when(_c("hard_any"), "low").otherwise("medium"))
        .when(m.contains("execute"), "low")
    )


def _command() -> Column:
    spread = _c("chain").isNotNull()
    started = F.when(spread | _c("receiver_ext"), "high").when(_c("receiver_tainted"), "medium").otherwise("none")
    other = F.when(_c("ext") | spread, "high").when(_c("tainted"), "medium").when(_c("hard_all"), "none").when(_c("hard_any"), "low").otherwise("medium")
    return F.nullif(F.when(_c("method") == "start", started).otherwise(other), F.lit("none"))


def _spread(otherwise: str, chained: str = "medium") -> Column:
    return F.when(_c("ext"), "high").when(_c("chain").isNotNull(), chained).otherwise(otherwise)


def _ssrf() -> Column:
    made = _c("receiver_type").endswith("URL")
    return F.when(made & _c("ext"), "high").when(_c("method") == "openConnection", "medium").when(_c("chain").isNotNull(), "medium").otherwise("low")


def _xml() -> Column:
    parse = (_c("method") == "parse") & _c("receiver_type").endswith("DocumentBuilder")
    made = (_c("method") == "newInstance") & _c("receiver_type").endswith("DocumentBuilderFactory")
    return F.when(parse & ~_c("hardened"), "high").when(parse & _c("ext"), "medium").when(made, "medium")


def _directory() -> Column:
    m = _c("method")
    found = F.when(_c("ext"), "critical").when(_c("chain").isNotNull(), "high").otherwise("medium")
    return F.when(m.isin("compile", "evaluate"), _spread("low")).when(m == "search", _spread("medium")).when(m == "lookup", found)


def _words() -> tuple[Column, Callable[..., Column]]:
    """The algorithm, as far as it is settled, else the arguments; and whether it has a word (word borders are ASCII)."""
    a = F.coalesce(_c("settled"), _c("args"), F.lit(""))
    return a, lambda w, fold="": a.rlike(rf"{fold}(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)")


def _crypto() -> Column:
    a, word = _words()
    weak = (word("DES") & ~word("DESede") & ~word("3DES")) | word("ECB") | word("RC4") | word("ARCFOUR") | (word("RSA") & ~word("OAEP"))
    short = word("MD5", "(?i)") | word("SHA-?1", "(?i)")
    return F.when(a == "", None).when(weak | short, "high").when(word("SHA-?(224|256|384|512|3)", "(?i)"), None).when(_c("ext"), "high").otherwise("low")


def _reflection() -> Column:
    name = _c("method") == "forName"
    return F.when(name & _c("ext"), "high").when(name & _c("hard_all"), "low").when(name, "medium").when(_c("chain").isNotNull() | _c("tainted"), "medium").otherwise("low")


def _log() -> Column:
    return F.when(_c("ext"), "high").when(_c("chain").isNotNull(), "medium")


def _why_crypto() -> Column:
    _, word = _words()
    return (
        F.when(word("DES") & ~word("DESede") & ~word("3DES"), "DES keys are too short").when(word("ECB"), "ECB shows equal blocks")
        .when(word("RC4") | word("ARCFOUR"), "RC4 is broken").when(word("RSA") & ~word("OAEP"), "RSA without OAEP padding")
        .when(word("MD5", "(?i)"), "MD5 has collisions").when(word("SHA-?1", "(?i)"), "SHA-1 has collisions")
        .when(_c("ext"), "the algorithm is chosen outside").otherwise("the algorithm is not known")
    )


def _why_sql() -> Column:
    spread = _c("ext") | _c("tainted") | _c("chain").isNotNull()
    return F.when(_c("method") == "createStatement", "a statement without parameters").when(spread, "put together in place of parameters").when(_c("hard_any"), "a fixed text")


def _why_command() -> Column:
    return F.when(_c("method") == "start", "a process is started").when(_c("hard_any") & ~_c("hard_all"), "a fixed text with other parts")


def _why_xml() -> Column:
    parse = _c("method") == "parse"
    return F.when(parse & ~_c("hardened"), "entities are not locked").when(parse, "locked, but it reads outside input").otherwise("lock entities before use")


def _why_directory() -> Column:
    m = _c("method")
    return F.when(m.isin("compile", "evaluate"), "an XPath expression").when(m == "search", "an LDAP filter").when(m == "lookup", "a JNDI name")


#: What a check adds to its rule's message.
WHY: dict[str, Callable[[], Column]] = {
    "crypto": _why_crypto, "sql": _why_sql, "command": _why_command, "xml": _why_xml, "directory": _why_directory,
    "ssrf": lambda: F.when(_c("method") == "openConnection", "a connection is opened"),
    "reflection": lambda: F.when(_c("method") == "forName", "a class by name").otherwise("an object of such a class"),
}

CHECKS: dict[str, Callable[[], Column]] = {
    "sql": _sql, "always": lambda: F.lit("high"), "command": _command, "chain": lambda: _c("chain"), "path": lambda: _spread("low"), "ssrf": _ssrf, "xml": _xml,
    "directory": _directory, "crypto": _crypto, "reflection": _reflection, "log": _log, "secret": lambda: F.when(_c("hard_any"), "high"),
}

# Rules, severities and patterns.
_SQL = ["java.sql.Statement.executeQuery(*)", "java.sql.Statement.executeUpdate(*)", "java.sql.Statement.execute(*)", "java.sql.Connection.createStatement(*)"]
_OBJECT = ["java.io.ObjectInputStream.readObject(*)", "java.io.ObjectInputStream.readUnshared(*)"]
RULES = [
    Rule("S001", "SQL injection", "high", _SQL, "SQL statement made of outside input", "sql"),
    Rule("S002", "Unsafe deserialization", "critical", _OBJECT, "Object read from an untrusted stream", "always"),
    Rule("S003", "Command injection", "critical", ["java.lang.Runtime.exec(*)", "java.lang.ProcessBuilder.command(*)", "java.lang.ProcessBuilder.start()", "java.lang.ProcessBuilder.ProcessBuilder(*)", "ProcessBuilder.ProcessBuilder(*)"], "Command made of outside input", "command"),
    Rule("S004", "Cross-file taint", "high", [*_SQL, *_OBJECT, "java.lang.Runtime.exec(*)", "java.lang.ProcessBuilder.start()", "java.lang.ProcessBuilder.command(*)"], "Outside input reaches a sink in another file", "chain", needs_chain=True),
    Rule("S005", "Path traversal", "high", ["java.io.FileInputStream.FileInputStream(*)", "java.io.FileOutputStream.FileOutputStream(*)", "java.io.FileReader.FileReader(*)", "java.io.FileWriter.FileWriter(*)", "java.io.File.File(*)"], "File path made of outside input", "path"),
    Rule("S006", "Server-side request forgery", "high", ["java.net.URL.URL(*)", "java.net.HttpURLConnection.openConnection(*)"], "Address made of outside input", "ssrf"),
    Rule("S007", "XML external entities", "critical", ["javax.xml.parsers.DocumentBuilder.parse(*)", "javax.xml.parsers.DocumentBuilderFactory.newInstance(*)", "javax.xml.transform.TransformerFactory.newInstance(*)", "javax.xml.validation.SchemaFactory.newInstance(*)", "org.xml.sax.XMLReader.parse(*)", "org.dom4j.io.SAXReader.read(*)"], "XML read without locking entities", "xml"),
    Rule("S008", "XPath, LDAP and JNDI injection", "critical", ["javax.xml.xpath.XPath.compile(*)", "javax.xml.xpath.XPath.evaluate(*)", "javax.naming.directory.DirContext.search(*)", "javax.naming.directory.InitialDirContext.search(*)", "javax.naming.directory.InitialDirContext.lookup(*)", "javax.naming.Context.lookup(*)", "javax.naming.InitialContext.lookup(*)"], "Query made of outside input", "directory"),
    Rule("S009", "Hard-coded secret", "high", ["javax.crypto.spec.SecretKeySpec.SecretKeySpec(*)", "java.sql.DriverManager.getConnection(*)"], "Key or password in the source", "secret"),
    Rule("S010", "Weak cryptography", "high", ["javax.crypto.Cipher.getInstance(*)", "java.security.MessageDigest.getInstance(*)"], "Weak algorithm", "crypto"),
    Rule("S011", "Unsafe reflection", "critical", ["java.lang.Class.forName(*)", "java.lang.Class.newInstance(*)", "java.lang.reflect.Constructor.newInstance(*)"], "Class chosen by outside input", "reflection"),
    Rule("S012", "Insecure randomness", "medium", ["java.util.Random.Random(*)", "java.util.Random.nextLong(*)", "java.util.Random.nextInt(*)", "java.util.Random.nextDouble(*)", "java.util.Random.nextFloat(*)", "java.util.Random.nextBoolean(*)", "java.util.Random.nextBytes(*)", "java.util.Random.nextGaussian(*)"], "Predictable random numbers", "always"),
    Rule("S013", "Log injection", "medium", ["java.util.logging.Logger.info(*)", "java.util.logging.Logger.warning(*)", "java.util.logging.Logger.severe(*)", "java.util.logging.Logger.fine(*)", "java.util.logging.Logger.finer(*)", "java.util.logging.Logger.finest(*)", "java.util.logging.Logger.log(*)"], "Log entry made of outside input", "log"),
]


def told(rules: list[Rule]) -> Column:
    """The message of an alert: what the rule says, why its check holds, the outside input and parameters it found."""
    what = F.coalesce(*(F.when(_c("rule_id") == r.id, F.lit(r.description or r.name)) for r in rules), F.lit(""))
    named = F.coalesce("names", F.lit("")) != ""
    source = F.when(named & _c("ext"), F.concat(F.lit(": outside input "), "names")).when(named & _c("tainted"), F.concat(F.lit(": parameter "), "names"))
    why = F.coalesce(*(F.when(_c("rule_id") == r.id, WHY[r.check]()) for r in rules if r.check in WHY), F.lit(None).cast("string"))
    what = F.concat(what, F.coalesce(F.concat(F.lit(" - "), why), F.lit("")))
    made = F.when(_c("receiver_ext"), " (receiver made of outside input)").when(_c("receiver_tainted"), " (receiver made of a parameter)")
    return F.concat(what, F.coalesce(source, F.lit("")), F.coalesce(made, F.lit("")))


def decide(matched: DataFrame, rules: list[Rule], checks: dict[str, Check] | None = None) -> DataFrame:
    """matched (site context, rule_id) with ``confidence`` and ``message``; rows without an alert go. Rules that name one of
    ``checks`` are decided by it, all others by column expressions."""
    own = {r.id: r.check for r in rules if checks and r.check in checks}
    if own:
        asked = checked(matched, own, checks).where("verdict_alert").withColumn("confidence", F.col("verdict"))
        asked = asked.withColumn("message", F.coalesce("verdict_message", told(rules))).drop("verdict_alert", "verdict_message", "verdict")
        needed = [r.id for r in rules if r.needs_chain]
        asked = asked.where(~_c("rule_id").isin(*needed) | _c("chain").isNotNull()) if needed else asked
        others = matched.where(~_c("rule_id").isin(*own))
        return decide(others, [r for r in rules if r.id not in own]).unionByName(asked)
    listed = [F.when(_c("rule_id") == r.id, F.coalesce(CHECKS[r.check](), F.lit("none"))) for r in rules if r.check in CHECKS]
    broken = [r.id for r in rules if r.check and r.check not in CHECKS]
    otherwise = F.when(_c("rule_id").isin(*broken), "low").otherwise("medium") if broken else F.lit("medium")
    needed = [r.id for r in rules if r.needs_chain]
    out = matched.withColumn("confidence", F.coalesce(*listed, otherwise)).withColumn("message", told(rules))
    return out.where((_c("confidence") != "none") & (~_c("rule_id").isin(*needed) | _c("chain").isNotNull()))
