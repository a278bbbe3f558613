"""Rules of text, identifiers and rights, applied to every order: each order takes one of a rule's cases in turn, and the oracle holds the literal results."""

from __future__ import annotations

from collections.abc import Callable, Sequence


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import identifiers, json_text, text
from sluice.operators import rules, views
from sluice.plans.registry import query
from sluice.session import table


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def golden(name: str, schema: str, cases: Sequence[tuple], rule: Callable[..., Column], doc: str) -> None:
    """Register a rule: cases are tuples of its inputs (by schema) and, last, the expected result as text."""
    expected = ", ".join(f"({i}, {_quoted(c[-1])})" for i, c in enumerate(cases))
    sql = f'SELECT i AS "case", result, count(*)::bigint AS n FROM orders JOIN (VALUES {expected}) v(i, result) ON o_orderkey % {len(cases)} = i GROUP BY ALL'
    names = [f.split()[0] for f in schema.split(", ")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(cases)], f"case long, {schema}")
        rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % len(cases)).alias("case")).join(F.broadcast(inputs), "case")
        return rows.withColumn("result", rule(*map(F.col, names)).cast("string")).groupBy("case", "result").agg(F.count(F.lit(1)).alias("n"))

    run.__name__, run.__doc__ = name, doc
    query(name, sql)(run)


def _joined(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def _fields(value: Column, *names: str) -> Column:
    return _joined(*[value[n] for n in names])


def _each(array: Column, *names: str) -> Column:
    return F.array_join(F.transform(array, lambda x: _fields(x, *names)), ";")


golden(
    "doi_rules",
    "value string",
    [
        ("https://doi.org/10.1234/ABC.1).", "10.1234/abc.1"),
        ("10.1000/a+b", "10.1000/a+b"),
        ("doi: 10.5555/12345678", "10.5555/12345678"),
        ("http://dx.doi.org/10.5555/12%2F34?x=1", "10.5555/12/34"),
        ("10.1000/x:]", "10.1000/x:]"),
        ("doi.org/10.1000/x", None),
        ("10.12/short", None),
        ("10.1000/has space", None),
        ("", None),
        (None, None),
        ("  10.5194/EGUSPHERE-2024-1 ;", "10.5194/egusphere-2024-1"),
    ],
    identifiers.canonical_doi,
    "DOIs in canonical form.",
)
golden(
    "identifier_rules",
    "scheme string, value string",
    [
        ("arxiv", "arXiv:2401.00001v3", "2401.00001"),
        ("arxiv", "https://arxiv.org/pdf/2401.00001v2.pdf", "2401.00001"),
        ("ORCID", "https://orcid.org/0000-0002-1825-009x", "0000-0002-1825-009X"),
        ("orcid", "nonsense", None),
        ("ror", "https://ror.org/02MHBDP94", "02mhbdp94"),
        ("ror", "12mhbdp94", None),
        ("pmid", "PMID12345", "12345"),
        ("pmid", "12a45", None),
        ("pmcid", "123", "PMC123"),
        ("pmcid", "pmc77", "PMC77"),
        ("openalex", "https://openalex.org/w123", "W123"),
        ("openalex", "nonsense", None),
        ("handle", "  a   b ", "a b"),
        ("handle", "", None),
        ("doi", "nonsense", None),
    ],
    identifiers.canonical_identifier,
    "Identifiers of each scheme in canonical form, null where they are none.",
)
golden(
    "doi_in_text",
    "value string",
    [("see https://doi.org/10.1234/Abc-1, and 10.5/x", "10.1234/abc-1"), ("no identifier", None), ("(10.1000/182).", "10.1000/182"), (None, None)],
    identifiers.extract_doi,
    "The first DOI of a text.",
)
golden(
    "licence_rules",
    "value string",
    [
        ("https://creativecommons.org/licenses/by/4.0/", "cc-by-4.0"),
        ("http://creativecommons.org/licenses/by-nc-sa/3.0/de", "cc-by-nc-sa-3.0"),
        ("CC BY-NC 4.0", "CC-BY-NC-4.0"),
        ("cc-by", "CC-BY-4.0"),
        ("Creative_Commons Attribution 4.0", "CC-BY-4.0"),
        ("MIT", "MIT"),
        (" All rights reserved ", "All rights reserved"),
        ("CC0", "CC0"),
        ("", None),
        (None, None),
    ],
    text.canonical_licence,
    "Licences by their usual names.",
)
golden(
    "release_rules",
    "object_type string, licence string, allows boolean, back boolean",
    [
        ("review_text", "cc-by-4.0", False, False, "pointer_hash|CC-BY-4.0|false|false|false"),
        ("review_text", "https://creativecommons.org/licenses/by/4.0/", None, False, "redistribute|cc-by-4.0|true|false|false"),
        ("review_text", "CC0", True, False, "redistribute|CC0|false|false|false"),
        ("review_text", "CC BY-NC-SA 4.0", None, False, "redistribute|CC-BY-NC-SA-4.0|true|true|true"),
        ("review_text", "CC BY-SA 4.0", True, False, "redistribute|CC-BY-SA-4.0|true|true|false"),
        ("review_text", "CC BY-NC 4.0", True, False, "derived_only|CC-BY-NC-4.0|false|false|false"),
        ("email", None, None, False, "exclude|-|false|false|false"),
        ("abstract", None, None, True, "exclude|-|false|false|false"),
        ("abstract", "unknown", None, None, "derived_only|unknown|false|false|false"),
        ("email", "MIT", None, False, "redistribute|MIT|true|false|false"),
    ],
    lambda kind, licence, allows, back: _fields(text.release_decision(kind, licence, allows, back), "release_class", "licence", "attribution", "share_alike", "noncommercial"),
    "What may be released of an object.",
)
golden(
    "declared_release_rules",
    "object_type string, licence string, declared string",
    [("work", "MIT", "redistribute", "redistribute"), ("work", "unknown", "redistribute", "pointer_hash"), ("work", "MIT", "derived_only", "derived_only"), ("email", None, None, "exclude"), ("work", "CC BY 4.0", None, "redistribute")],
    text.declared_release,
    "The release class of objects that their sources have classed.",
)
golden(
    "outcome_rules",
    "value string",
    [
        ("Accept (poster)", "accepted"),
        ("conditionally accepted", "accepted"),
        ("Reject", "rejected"),
        (" withdrawn by authors", "withdrawn"),
        ("ICLR 2021 Oral", "other_or_unresolved"),
        (None, "other_or_unresolved"),
        ("Strong Accept", "accepted"),
    ],
    text.outcome_class,
    "Outcomes by the beginning of their native name.",
)
golden(
    "independent_outcome_rules",
    "value string",
    [
        ("ICLR 2021 Spotlight", "accepted"),
        ("Publish", "selected"),
        ("publish with changes", None),
        ("accepted, later withdrawn", "accepted"),
        ("Desk Rejected", "rejected"),
        ("declined", "rejected"),
        ("funded", None),
        ("Withdrawn", "withdrawn"),
        ("unclear provider state", None),
        (None, None),
    ],
    text.independent_outcome,
    "Outcomes that a native text names by itself.",
)
golden(
    "evaluation_rules",
    "kind string, official boolean, invitation string",
    [
        ("official_review", True, None, "peer_review|official"),
        ("review", None, "X/-/Meta_Review", "editorial_or_meta_evaluation|unspecified"),
        ("comment", None, "Public_Comment", "public_comment|not_official_by_type"),
        ("comment", False, "Official_Comment", "other_evaluation|not_official"),
        ("office action", None, None, "patent_office_action|unspecified"),
        ("panel score", True, None, "funding_panel_evaluation|official"),
        (None, None, None, "other_evaluation|unspecified"),
        ("referee report", False, None, "peer_review|not_official"),
    ],
    lambda k, o, i: _fields(text.evaluation_class(k, o, i), "evaluation_class", "official_status"),
    "Classes of evaluations and whether they are official.",
)
golden(
    "role_rules",
    "invitations array<string>",
    [
        (["V/-/Ethics_Review"], "ethics_review"),
        (["V/-/Meta_Review"], "meta_review"),
        (["V/-/Official_Review", "V/-/Edit"], "official_review"),
        (["V/-/Decision"], "decision"),
        (["V/-/Rebuttal"], "author_response"),
        (["V/-/Revision"], "revision"),
        (["V/-/Public_Comment"], "public_comment"),
        (["V/-/Withdrawal"], "withdrawal"),
        (["V/-/Desk_Reject"], "desk_rejection"),
        (["V/-/Submission"], "submission"),
        ([], "auxiliary"),
        (None, "auxiliary"),
    ],
    text.invitation_role,
    "Roles of notes by their invitations.",
)
golden(
    "comment_role_rules",
    "doi string, title string, subtype string",
    [
        ("10.5194/x-2024-1-RC2", None, None, "referee_comment"),
        ("10.5194/x-2024-1-AC1", None, None, "author_comment"),
        ("10.5194/x-2024-1-CC1", None, None, "community_comment"),
        ("10.5194/x-2024-1-EC1", None, None, "editor_comment"),
        ("10.5194/x-2024-1-SC1", None, None, "short_comment"),
        ("10.5194/x", "Reply by Author", None, "author_comment"),
        ("10.5194/x", None, "community-comment", "community_comment"),
        ("10.5194/x", None, None, "comment_unresolved"),
    ],
    text.comment_role,
    "Authors of comments by DOI, title and subtype.",
)
golden(
    "context_rules",
    "venue string",
    [
        ("OI_Fund/2024", "funding"),
        ("NeurIPS.cc/2023/Competition", "competition"),
        ("ICLR.cc/2024/Workshop/X", "workshop"),
        ("ICML.cc/2024/Conference", "conference"),
        ("X/Proceedings", "proceedings"),
        ("Papers/2020", "journal_or_series"),
        ("University/Course", "course_or_training"),
        ("TMLR", "other_selection_process"),
    ],
    text.selection_context,
    "Kinds of selection processes by venue.",
)
golden(
    "provider_status_rules",
    "notice string",
    [
        ("This  preprint has been rejected.", "affirmative_rejected_after_public_discussion"),
        ("The manuscript was withdrawn by the authors", "affirmative_author_withdrawal_after_public_discussion"),
        ("This paper has been retracted", "affirmative_retraction_after_public_discussion"),
        ("A final paper is not foreseen.", "affirmative_discontinued_after_public_discussion"),
        ("This preprint is currently under review", "provider_visible_review_ongoing_censored"),
        ("Something else", "provider_status_other_censored"),
        ("  ", "public_discussion_outcome_unresolved_censored"),
        (None, "public_discussion_outcome_unresolved_censored"),
    ],
    text.provider_status,
    "What providers' notices say.",
)
golden(
    "invitation_rules",
    "invitation string, invitations array<string>, venue string",
    [
        ("V/-/Official_Review", [], None, "V/-/Official_Review"),
        (None, ["V/-/Submission", "V/-/Decision", "V/-/Comment"], None, "V/-/Decision"),
        (None, ["V/-/Review_A", "V/-/Review_B"], None, "V/-/Review_B"),
        (None, ["V/Rejected_Submission", "V/-/Decision"], "V/Rejected_Submission/", "V/Rejected_Submission"),
        ("", None, None, "unknown"),
        (None, ["V/-/Edit"], "V/Active", "V/-/Edit"),
    ],
    lambda i, all_, venue: text.primary_invitation(i, all_, venue, F.lit(None).cast("string")),
    "The typed invitation of a note.",
)
golden("invitation_kinds", "invitation string", [("V/-/Desk_Rejection", "decision"), ("V/-/Desk_Reject", "decision"), ("V/-/Meta_Review", "evaluation"), ("V/-/Author_Response", "discussion"), ("V/-/Withdraw", "withdrawal"), ("V/-/Submission", "submission"), ("x", "unknown")], text.invitation_kind, "Kinds of invitations.")
golden(
    "public_configuration_rules",
    "content map<string,string>",
    [({"submission_name": "S", "contact_email": "a@b", "other": "x"}, "submission_name"), ({"review_message_sender": "y"}, ""), ({"Title": "t", "start_date": "d"}, "Title,start_date")],
    lambda m: F.array_join(F.array_sort(F.map_keys(text.public_configuration(m))), ","),
    "Settings that may be published.",
)
golden(
    "field_rules",
    "label string",
    [("Quantum theory", "physics|1.0"), ("Physics", "-|0.0"), ("Machine Learning", "computer science|1.0"), ("Biomedical Engineering", "-|0.0"), ("Poetry", "-|0.0"), ("Earth science", "earth and environmental sciences|1.0")],
    lambda c: _fields(text.field_of(c), "normalized_label", "score"),
    "Broad fields of native labels; none where several are named.",
)
golden(
    "field_candidate_rules",
    "label string",
    [("Biomedical Engineering", "engineering|0.5;biology and medicine|0.5"), ("Poetry", "-|0.0"), ("Climate Economics and Mathematics", "computer science|0.25;mathematics|0.25;earth and environmental sciences|0.25;social sciences|0.25"), ("Statistics and machine learning", "computer science|0.5;mathematics|0.5")],
    lambda c: _each(text.field_candidates(c), "normalized_label", "score"),
    "All broad fields of a native label with equal weights.",
)
golden(
    "rubric_rules",
    "label string",
    [("Overall rating", "overall_recommendation"), ("Novelty and soundness", "novelty_originality,soundness_evidence"), ("Soundness, code and harm", "ethics,reproducibility,soundness_evidence"), ("Length", "")],
    lambda c: F.array_join(text.rubric_constructs(c), ","),
    "Constructs that a rubric's label names.",
)
golden(
    "construct_span_rules",
    "value string",
    [
        ("The novelty is clear; presentation and Novel code.", "novelty_originality|4|11;clarity|22|34;reproducibility|45|49"),
        ("No rescore here", ""),
        ("Ethics, ethical.", "ethics|0|6"),
        ("Data availability of risk", "reproducibility|0|17;risk_feasibility|21|25"),
        (None, ""),
    ],
    lambda c: _each(text.construct_spans(c), "construct", "span_start", "span_end"),
    "First whole-word mention of each construct.",
)
golden(
    "repository_link_rules",
    "value string",
    [("Code at https://github.com/a/b. Data: http://www.Zenodo.org/record/1, (https://osf.io/x)", "https://github.com/a/b|github.com;http://www.Zenodo.org/record/1|zenodo.org;https://osf.io/x|osf.io"), ("https://example.org/a", ""), (None, "")],
    lambda c: _each(text.repository_links(c), "url", "host"),
    "Research objects that a text links to.",
)
golden(
    "claim_rules",
    "value string",
    [("We show a method; this paper introduces data and code. Limitation: uncertain.", "2|1|0|2|2"), ("", "0|0|0|0|0"), ("A randomised benchmark survey on GitHub", "0|1|2|0|1")],
    lambda c: _joined(*text.claim_counts(c).values()),
    "Statements of each kind in a text.",
)
golden(
    "moment_rules",
    "value string",
    [
        ("2020", "2020-01-01 00:00:00"),
        ("2020-02-03", "2020-02-03 00:00:00"),
        ("2020-02-03T04:05:06Z", "2020-02-03 04:05:06"),
        ("2020-02-03T04:05:06+02:00", "2020-02-03 02:05:06"),
        ("Mon, 3 Feb 2020 04:05:06 GMT", "2020-02-03 04:05:06"),
        ("3 Feb 2020 04:05:06 -0500", "2020-02-03 09:05:06"),
        ("soon", None),
        (None, None),
    ],
    text.moment,
    "Times from years, ISO dates and mail headers.",
)
golden("epoch_rules", "value string", [("1577836800000", "2020-01-01 00:00:00"), ("1.5778368e12", "2020-01-01 00:00:00"), ("x", None), (None, None)], text.epoch_moment, "Times from milliseconds.")
golden("quarter_rules", "value string", [("2020-05-01", "2020|2"), ("2021-12-31", "2021|4"), (None, "1970|1")], lambda c: _fields(text.year_quarter(text.moment(c)), "year", "quarter"), "Year and quarter of a time.")
golden("number_rules", "value string", [("8: Top 50%", "8.0"), ("score -1.5 of 3", "-1.5"), ("none", None), (None, None)], text.first_number, "The first number in a text.")
golden(
    "json_path_rules",
    "value string",
    [('{"b": {"y": [1, 2], "x": 1}, "a": "t"}', 'a="t";b.x=1;b.y=[1, 2]'), ("[1]", "=[1]"), ("{bad", ""), ("{}", ""), (None, "")],
    lambda c: F.array_join(F.transform(json_text.json_paths(c), lambda r: F.concat(r["path"], F.lit("="), r["value"])), ";"),
    "Leaves of nested objects by path.",
)
golden("json_canonical_rules", "value string", [('{"b":1,"a":"é"}', '{"a": "\\u00e9", "b": 1}'), ("[1,2]", "[1, 2]"), ("x", None), (None, None)], json_text.canonical_json, "JSON in canonical form.")
golden("json_wrapped_rules", "value string", [('{"a":1}', '{"a": 1}'), ("free text", '{"unparsed_native_value": "free text"}'), ("", None), (None, None)], json_text.wrapped_json, "JSON, or the text that is none as an object.")
golden(
    "action_rules",
    "value string",
    [('[{"n": 1}, 2]', '{"n": 1}'), ('{"claims": [{"a": 1}, {"b": 2}]}', '{"a": 1};{"b": 2}'), ('{"claims": 3, "data": [{"c": 3}]}', '{"c": 3}'), ('{"x": []}', ""), ("bad", ""), (None, "")],
    lambda c: F.array_join(json_text.action_list(c), ";"),
    "Actions under any of their usual keys.",
)
golden("matching_share_rules", "a string, b string", [("abcd", "bcde", "0.75"), ("a title", "a title", "1.0"), ("x", "y", "0.0"), (None, "y", None)], text.matching_share, "Matching shares of two texts.")
golden("title_similarity_rules", "a string, b string", [("The  Title!", "the title", "1.0"), ("", "x", "0.0"), (None, "x", "0.0"), ("abcd", "bcde", "0.75")], text.title_similarity, "Similarity of titles.")
golden("bibliography_rules", "value string", [("See https://x.org/a: The Title, 2nd_ed.", "see the title 2nd_ed"), ("É (x)", "é x"), (None, "")], text.bibliography_key, "Bibliography keys.")
golden(
    "language_rules",
    "value string",
    [
        ("the cat and the dog of the house in the garden with a very long tail that nobody has ever seen here", "en|1.0|marker-abstention/1"),
        ("der Hund und die Katze von der Frau mit dem Haus " * 3, "de|1.0|marker-abstention/1"),
        ("the and", "-|0.0|insufficient-text"),
        ("le la et de avec el la y de con " * 3, "-|0.0|marker-abstention/1"),
        ("word1 " * 40, "-|0.0|insufficient-text"),
        (None, "-|0.0|insufficient-text"),
    ],
    lambda c: _fields(text.language_detail(c), "language", "confidence", "method"),
    "Languages with their confidence and method.",
)
golden(
    "leak_rules",
    "view string, available int, decided int, role string",
    [("entry_selection", 2, 1, "review", "true"), ("entry_selection", 1, 2, "review", "false"), ("entry_selection", None, 2, "review", "false"), ("entry_selection", 1, 2, "final_version", "true"), ("afterlife", 3, 1, "future_citation", "false")],
    lambda view, a, d, r: F.when(view == "afterlife", views.inadmissible("afterlife", a, d, r)).otherwise(views.inadmissible("entry_selection", a, d, r)),
    "Features that a view may not use.",
)
golden(
    "grade_rules",
    "grade string, ratio double, violated boolean",
    [("A", 0.99, False, "A"), ("A", 0.9, False, "U"), ("B", None, False, "U"), ("B", 1.0, True, "U"), ("C", 0.1, True, "C"), (None, 1.0, False, None)],
    rules.effective_grade,
    "Grades that are left by coverage and violations.",
)
golden(
    "claim_number_rules",
    "claims array<string>",
    [(["1. A device.", "2. The device of claim 1.", "no number"], "1=1. A device.;2=2. The device of claim 1.|"), (["1. A.", "1. B.", "3) C"], "1=1. A.;3=3) C|1"), ([], "|"), (None, "|")],
    lambda c: F.concat_ws("|", F.array_join(F.transform(F.map_entries(text.claim_numbers(c)["claims"]), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ";"), F.array_join(text.claim_numbers(c)["ambiguous"].cast("array<string>"), ",")),
    "Claims by number, and numbers that several claims have.",
)
golden(
    "pointer_rules",
    "url string, target string, locator string, bytes string, text string, verified boolean, automatic boolean",
    [
        ("https://a.org/x", "https://a.org/y", "l", "ab" * 32, None, True, False, ""),
        ("https://a.org/x", "https://a.org/y", "l", None, "cd" * 32, True, None, ""),
        ("http://a.org/x", None, " ", "0" * 64, None, True, False, "source_url,retrieval_target,object_locator,expected_hash"),
        ("https://localhost", "https://a", "l", "ab" * 32, None, None, True, "hash_verification_required,automatic_redistribution_allowed"),
    ],
    lambda *c: F.array_join(text.pointer_problems(*c), ","),
    "What is wrong with pointers.",
)
golden("sha_rules", "value string", [("ab" * 32, "true"), ("0" * 64, "false"), ("xyz", "false"), (None, "false")], text.genuine_sha256, "Plausible digests.")


def _uuid(value: str) -> str:
    import uuid

    return str(uuid.uuid5(identifiers.NAMESPACE, value))


golden(
    "stable_id_rules",
    "a string, b string",
    [("Src", "A  b", "obs:candidate:" + _uuid("candidate|src|a b")), (" x ", "ﬁ", "obs:candidate:" + _uuid("candidate|x|fi")), ("s", "É", "obs:candidate:" + _uuid("candidate|s|é"))],
    lambda a, b: identifiers.stable_id("candidate", a, b),
    "Deterministic ids.",
)
