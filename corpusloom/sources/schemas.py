"""Declared schemas: production reads never infer."""

TEXT = "text string"
WEB_TEXT = "id bigint, text string"
CODE = "whole_func_string string, func_documentation_string string, language string"
SEARCH_PAGE = "items array<struct<repository: struct<full_name: string>>>"
METADATA = "repo string, stargazers_count int"
TREE = "repo string, branch string, tree array<struct<path: string, url: string>>"
BLOB = "url string, content string"
VOCAB = "token string, idx int"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
