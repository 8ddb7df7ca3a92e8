"""What query expansion adds to a keyword, by the framework that it names and by its synonyms."""

#: Terms of a framework, added to keywords that contain its name.
DOMAIN_TERMS = {
    "django": "orm queryset model migration admin form view template middleware url signal manager field validator serializer".split(),
    "sympy": "symbolic expression simplify solve integral derivative matrix function assumption evalf subs expand".split(),
    "sphinx": "directive role domain builder extension parser transform node translator".split(),
    "flask": "route blueprint request response session jinja template url_for".split(),
    "scikit": "estimator predictor classifier regressor pipeline transformer preprocessing".split(),
    "pytest": "fixture mark parametrize conftest hook plugin assertion".split(),
    "matplotlib": "axes figure plot artist renderer backend transform legend".split(),
    "requests": "session adapter response header cookie auth redirect".split(),
    "sqlalchemy": "session query mapper table column engine metadata relationship".split(),
    "pandas": "dataframe series index groupby merge pivot resample rolling".split(),
}

#: Pairs of synonyms; a keyword that equals one gets the other.
SYNONYMS = (
    ("validate", "validator"), ("validate", "validation"), ("validate", "check"), ("serialize", "serializer"), ("serialize", "marshalling"),
    ("deserialize", "parse"), ("deserialize", "unmarshal"), ("authenticate", "auth"), ("authenticate", "login"), ("authorize", "permission"),
    ("authorize", "acl"), ("config", "settings"), ("config", "configuration"), ("error", "exception"), ("error", "failure"), ("log", "logging"),
    ("log", "trace"), ("cache", "caching"), ("cache", "memoize"), ("render", "template"), ("render", "display"), ("query", "filter"),
    ("query", "search"), ("migrate", "migration"), ("migrate", "schema"), ("import", "require"), ("import", "include"), ("export", "output"),
    ("export", "dump"), ("encode", "encoding"), ("decode", "decoding"), ("regex", "pattern"), ("regex", "regular expression"), ("unicode", "utf"),
    ("unicode", "encoding"), ("async", "coroutine"), ("async", "await"), ("concurrent", "thread"), ("concurrent", "parallel"),
)
