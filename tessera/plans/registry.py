"""All queries and their SQL by name."""

from . import audits, curation, evaluation, files, pixels, provenance, serving

QUERIES = curation.Q | evaluation.Q | audits.Q | files.Q | pixels.Q | provenance.Q | serving.Q
SQL = curation.S | evaluation.S | audits.S | files.S | pixels.S | provenance.S | serving.S
