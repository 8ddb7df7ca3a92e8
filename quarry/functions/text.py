"""Text expressions: chunks, keywords, estimates, redaction and keyword classifiers, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_CHARS, CHUNK_OVERLAP = 900, 120
CHUNK_LINES, LINE_OVERLAP = 50, 10
FIELD_CHARS = 16_384
TRUNCATED, REDACTED = "[truncated]", "[redacted]"

#: What precedes a secret in a stored field.
SECRET_MARKERS = ("OPENAI_API_KEY=", "DASHSCOPE_API_KEY=", "XAI_API_KEY=", "Authorization: Bearer ", "authorization: Bearer ", "Bearer sk-")
#: The ordered classes of failure texts; every word of one list must occur.
FAILURES = (
    ("prompt_delivery", (("prompt", "deliver"),)), ("trust_gate", (("trust",),)), ("branch_divergence", (("branch", "stale"), ("branch", "diverg"))),
    ("gateway_routing", (("gateway",), ("routing",))), ("compile", (("compile",), ("build failed",), ("cargo check",))), ("test", (("test",),)),
    ("tool_runtime", (("tool failed",), ("runtime tool",), ("tool runtime",))), ("workspace_mismatch", (("workspace", "mismatch"),)),
    ("plugin_startup", (("plugin",),)), ("mcp_handshake", (("mcp", "handshake"),)), ("mcp_startup", (("mcp",),)),
)
#: First words of shell commands by intent, in the order that decides; rm comes before the writes.
INTENTS = tuple((name, tuple(words.split())) for name, words in (
    ("read_only", """ls cat head tail less more wc sort uniq grep egrep fgrep find which whereis whatis man info file stat du df free
        uptime uname hostname whoami id groups env printenv echo printf date cal bc expr test true false pwd tree diff cmp md5sum
        sha256sum sha1sum xxd od hexdump strings readlink realpath basename dirname seq yes tput column jq yq xargs tr cut paste awk sed"""),
    ("destructive", "shred wipefs rm"),
    ("write", "cp mv rm mkdir rmdir touch chmod chown chgrp ln install tee truncate shred mkfifo mknod dd"),
    ("network", "curl wget ssh scp rsync ftp sftp nc ncat telnet ping traceroute dig nslookup host whois ifconfig ip netstat ss nmap"),
    ("process", "kill pkill killall ps top htop bg fg jobs nohup disown wait nice renice"),
    ("package", "apt apt-get yum dnf pacman brew pip pip3 npm yarn pnpm bun cargo gem go rustup snap flatpak"),
    ("system_admin", """sudo su chroot mount umount fdisk parted lsblk blkid systemctl service journalctl dmesg modprobe insmod rmmod
        iptables ufw firewall-cmd sysctl crontab at useradd userdel usermod groupadd groupdel passwd visudo"""),
))
#: Subcommands of git that change nothing.
GIT_READ_ONLY = tuple("status log diff show branch tag stash remote fetch ls-files ls-tree cat-file rev-parse describe shortlog blame bisect reflog config".split())
#: Assignments before a command's first word.
ASSIGNMENTS = r"""^([A-Za-z0-9_]+=("[^"]*"|'[^']*'|[^ \t"']*)[ \t]+)+"""


def chunk_starts(text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Starts (from 0) of overlapping windows; the last one is the first that reaches the text's end."""
    step = max(1, size - min(overlap, size - 1))
    n = F.length(text)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int") * step, F.lit(step))).otherwise(F.array().cast("array<int>"))


def chunk_chars(text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of characters without the blank ones."""
    return F.filter(F.transform(chunk_starts(text, size, overlap), lambda s: F.substring(text, s + 1, F.lit(size))), lambda w: F.btrim(w, F.lit(" \n\t\r")) != "")


def text_lines(text: Column) -> Column:
    """Lines without their ends; a final line feed starts no further line."""
    plain = F.regexp_replace(text, "\r\n", "\n")
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(plain, "\n$", ""), "\n"))


def chunk_lines(text: Column, size: int = CHUNK_LINES, overlap: int = LINE_OVERLAP) -> Column:
    """Overlapping windows of lines as structs (line_start, line_end, text), lines counted from 1."""
    step = size - overlap

    def windows(lines: Column) -> Column:
        n = F.size(lines)
        starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int") * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct((s + 1).alias("line_start"), F.least(s + size, n).alias("line_end"), F.array_join(F.slice(lines, s + 1, size), "\n").alias("text")))

    return F.element_at(F.transform(F.array(text_lines(text)), windows), 1)  # as a lambda's variable the lines are cut once a text, not once a window


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4) + 1


def byte_token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4) + 1


def collapse_spaces(text: Column) -> Column:
    """Runs of ASCII white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \t\n\r\f\x0b]+", " "))


def ellipsis(text: Column, size: int) -> Column:
    """At most size characters, the last an ellipsis if any are missing."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit("…"))).otherwise(text)


def redact_secrets(text: Column) -> Column:
    """What follows a marker, up to white space, quote, comma or closing bracket, replaced; then cut to FIELD_CHARS."""
    for marker in SECRET_MARKERS:
        text = F.regexp_replace(text, marker.replace(".", r"\.") + "[^ \t\n\r'\",}\\]]*", marker + REDACTED)
    return F.when(F.length(text) > FIELD_CHARS, F.concat(F.substring(text, 1, FIELD_CHARS - len(TRUNCATED)), F.lit(TRUNCATED))).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Tags removed without a trace, six references decoded (the ampersand first), white space collapsed."""
    t = F.regexp_replace(html, "<[^>]*>", "")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return collapse_spaces(t)


def failure_class(text: Column) -> Column:
    low, out = F.lower(text), F.lit("infra")
    for name, ways in reversed(FAILURES):
        test = F.lit(False)
        for words in ways:
            one = F.lit(True)
            for w in words:
                one = one & F.contains(low, F.lit(w))
            test = test | one
        out = F.when(test, name).otherwise(out)
    return out


def command_intent(command: Column) -> Column:
    """One of eight intents by a command's first word behind assignments; git by its subcommand, sed by its -i."""
    parts = F.split(F.trim(command), "[ \t]+")
    first = F.split(F.regexp_replace(F.trim(command), ASSIGNMENTS, ""), "[ \t]+")[0]
    sub = F.get(F.filter(F.slice(parts, 2, 1 << 20), lambda p: ~F.startswith(p, F.lit("-"))), F.lit(0))
    out = F.when(first == "git", F.when(sub.isin(*GIT_READ_ONLY), "read_only").otherwise("write")).otherwise("unknown")
    for name, names in reversed(INTENTS):
        out = F.when(first.isin(*names), name).otherwise(out)
    return F.when((first == "sed") & F.contains(command, F.lit(" -i")), "write").otherwise(out)


def keywords(text: Column, limit: int = 8, least: int = 3) -> Column:
    """Identifiers with a capital or underscore, longest first (stable), without adjacent repeats, `limit` at most."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0))
    found = F.filter(found, lambda k: (F.length(k) >= least) & k.rlike("[A-Z_]"))
    ordered = F.transform(F.sort_array(F.transform(found, lambda k, i: F.struct((-F.length(k)).alias("l"), i.alias("i"), k.alias("k")))), lambda s: s["k"])
    return ordered


def import_files(text: Column) -> Column:
    """Files that a text's import lines may mean: the module's first part as `x.py` and `x/__init__.py`, each once."""
    lines = F.transform(text_lines(text), lambda x: F.trim(F.translate(x, "\t", " ")))
    module = F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("from ")), F.regexp_extract(x, "^from ([^ ]*)", 1)).when(F.startswith(x, F.lit("import ")), F.regexp_extract(x, "^import ([^ ,]*)", 1)))
    top = F.transform(F.array_compact(module), lambda x: F.split_part(F.rtrim(x, F.lit(",")), F.lit("."), F.lit(1)))
    named = F.array_distinct(F.filter(top, lambda x: ~x.isin("", "import")))
    return F.flatten(F.transform(named, lambda x: F.array(F.concat(x, F.lit(".py")), F.concat(x, F.lit("/__init__.py")))))
