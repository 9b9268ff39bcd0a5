"""Record schemas, as DDL strings."""

INSTITUTION = "struct<id: string, display_name: string, country_code: string, type: string>"
AUTHORSHIP = f"struct<id: string, display_name: string, orcid: string, position: int, author_position: string, is_corresponding: boolean, institutions: array<{INSTITUTION}>>"
TOPIC = "struct<id: string, name: string, score: double>"
AUTHORSHIPS, TOPICS = f"array<{AUTHORSHIP}>", f"array<{TOPIC}>"
SOURCE = "struct<id: string, name: string, type: string, issn_l: string>"

#: A work as saved by a search and read by every analysis.
WORK = (
    "id string, doi string, title string, publication_year int, publication_date string, type string, cited_by_count int, is_oa boolean, "
    f"source {SOURCE}, topics array<{TOPIC}>, abstract string, abstract_inverted_index map<string, array<int>>, authors array<{AUTHORSHIP}>, referenced_works array<string>"
)
#: What conference sources add.
CONFERENCE = "source_record_id string, pdf_url string, landing_url string, external_ids map<string, string>, provenance array<string>"
#: Identity row of the citation graph.
PAPER = (
    "id string, openalex_id string, s2_id string, s2_corpus_id string, doi string, arxiv_id string, title string, year int, venue string, "
    "authors array<string>, citation_count int, reference_count int, url string, provider string, provider_ids map<string, string>"
)
DISCOVERY = "struct<round: int, source: string, keywords: string, parent_ids: array<string>, search_rank: int>"
#: A row of the paper store.
STORE = (
    "corpus_id string, openalex_id string, doi string, title string, abstract string, year int, venue string, authors array<string>, citation_count int, reference_count int, "
    "reference_ids array<string>, citation_ids array<string>, parent_ids array<string>, search_rank int, llm_score double, embedding_sim double, keyword_match_score double, "
    f"in_domain_citations bigint, in_domain_citation_score double, importance_score double, is_seed boolean, is_evaluated boolean, tags array<string>, discovery_history array<{DISCOVERY}>"
)
HOMEPAGE = "scholar_name string, homepage_url string, source string, affiliation string, url_type string, source_record_id string, confidence double, collected_at string, extra map<string, string>"
EDGE = "citing_id string, cited_id string, provider string"
