"""Query texts and the postfix compiler."""
