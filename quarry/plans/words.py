"""Words of the dialect (fixed values)."""

CLAUSES = "SELECT ALL FROM WHERE GROUP BY ORDER LIMIT AS ASC DESC AND OR NOT IS IN BETWEEN NULL TRUE FALSE TIMESTAMP".split()
AGGREGATES = "COUNT SUM AVG MIN MAX".split()
#: Recognised in order to say that they are not supported.
REJECTED = (
    "JOIN INNER LEFT RIGHT FULL CROSS ON HAVING DISTINCT CASE WHEN THEN ELSE END "
    "UNION INTERSECT EXCEPT INSERT UPDATE DELETE CREATE WITH WINDOW OVER OFFSET FETCH"
).split()
RESERVED = {*CLAUSES, *AGGREGATES, *REJECTED}
