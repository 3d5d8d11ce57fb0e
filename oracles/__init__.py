"""SQL statements that give the same answers as the registered queries."""

from oracles import days, hours, rules


def all_statements():
    return {**hours.STATEMENTS, **days.STATEMENTS, **rules.STATEMENTS}
