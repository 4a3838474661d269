"""Named queries, their inputs and the SQL that states their results."""
