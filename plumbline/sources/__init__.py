"""Table references and what is read from catalogs, workbooks and SQL scripts."""
