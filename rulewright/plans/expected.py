"""Expected rows of the queries on literal cases: worked out case by case from the semantics that the operators state.

name -> (columns, rows). The first value of a row of a dealt query is the number of its case.
"""

from __future__ import annotations

EXPECTED: dict[str, tuple[list[str], list[tuple]]] = {}

EXPECTED["q09_off_example_atoms"] = (
    ["atom", "status"],
    [
        (3, 'flies(b)', 'ALWAYS'),
        (4, 'right(a)', 'NEVER'),
    ],
)

EXPECTED["q100_controlled_runs"] = (
    ["policy", "error", "n_calls", "gold_steps", "first_truth", "first_said", "first_on_path", "gold_first", "any_illegal", "has_text", "retractions"],
    [
        (0, 'always_yes', None, 2, 17, None, None, None, True, False, True, 0),
        (0, 'empty', 'unparseable:role', 1, 17, None, None, None, True, False, False, 0),
        (0, 'reference', None, 17, 17, True, True, True, True, False, True, 0),
        (1, 'always_yes', None, 1, 13, None, None, None, False, False, True, 0),
        (1, 'empty', 'unparseable:role', 1, 13, None, None, None, False, False, False, 0),
        (1, 'reference', None, 13, 13, False, False, True, False, False, True, 0),
        (2, 'always_yes', None, 2, 22, None, None, None, False, False, True, 0),
        (2, 'empty', 'unparseable:role', 1, 22, None, None, None, False, False, False, 0),
        (2, 'reference', None, 22, 22, False, False, True, False, False, True, 0),
        (3, 'always_yes', None, 0, 1, None, None, None, None, False, True, 0),
        (3, 'empty', 'unparseable:role', 1, 1, None, None, None, None, False, False, 0),
        (3, 'reference', None, 1, 1, None, None, None, None, False, True, 0),
        (4, 'always_yes', None, 0, 1, None, None, None, None, False, True, 0),
        (4, 'empty', 'unparseable:role', 1, 1, None, None, None, None, False, False, 0),
        (4, 'reference', None, 1, 1, None, None, None, None, False, True, 0),
        (5, 'always_yes', None, 1, 4, None, None, None, True, False, True, 0),
        (5, 'empty', 'unparseable:role', 1, 4, None, None, None, True, False, False, 0),
        (5, 'reference', None, 4, 4, True, True, True, True, False, True, 0),
        (6, 'always_yes', 'role_failed', 0, 1, None, None, None, None, False, False, 0),
        (6, 'empty', 'unparseable:role', 1, 1, None, None, None, None, False, False, 0),
        (6, 'reference', 'empty:role', 1, 1, None, None, None, None, False, False, 0),
    ],
)

EXPECTED["q101_probes"] = (
    ["kind", "n", "n_yes"],
    [
        (0, 'check', 2, 1),
        (0, 'fold', 2, None),
        (0, 'introduce', 2, None),
        (0, 'role', 1, None),
        (0, 'subsume', 1, 0),
        (1, 'check', 2, 1),
        (1, 'fold', 2, None),
        (1, 'introduce', 2, None),
        (1, 'role', 1, None),
        (1, 'subsume', 2, 1),
        (2, 'check', 2, 1),
        (2, 'fold', 2, None),
        (2, 'introduce', 2, None),
        (2, 'role', 1, None),
        (2, 'subsume', 1, 0),
        (3, 'role', 1, None),
        (4, 'role', 1, None),
        (5, 'check', 1, 1),
        (5, 'fold', 1, None),
        (5, 'role', 1, None),
        (5, 'subsume', 1, 0),
    ],
)

EXPECTED["q102_probe_aggregate"] = (
    ["kind", "n", "accuracy", "score", "chance", "balanced", "n_reuse", "n_fresh", "accuracy_reuse", "accuracy_fresh", "reuse_rate", "policy"],
    [
        ('check', 27, 0.556, 0.556, 0.5, 0.5, 0, 0, None, None, None, 'always_yes'),
        ('check', 27, 1.0, 0.778, 0.5, 1.0, 0, 0, None, None, None, 'oracle'),
        ('fold', 27, 0.0, 0.0, 0.0, None, 0, 0, None, None, None, 'always_yes'),
        ('fold', 27, 1.0, 1.0, 0.0, None, 0, 0, None, None, None, 'oracle'),
        ('introduce', 24, 0.0, 0.0, 0.0, None, 0, 0, None, None, None, 'always_yes'),
        ('introduce', 24, 0.0, 0.0, 0.0, None, 0, 0, None, None, None, 'oracle'),
        ('role', 22, 0.318, 0.318, 0.0, None, 0, 0, None, None, None, 'always_yes'),
        ('role', 22, 1.0, 1.0, 0.0, None, 0, 0, None, None, None, 'oracle'),
        ('subsume', 19, 0.211, 0.211, 0.5, 0.5, 0, 0, None, None, None, 'always_yes'),
        ('subsume', 19, 1.0, 1.0, 0.5, 1.0, 0, 0, None, None, None, 'oracle'),
    ],
)

EXPECTED["q104_structure"] = (
    ["n_new_rules", "n_defeasible_rules", "n_contrary_rules", "n_new_assumptions", "is_defeasible", "is_monotonic", "is_intensional", "depth", "n_constants", "n_facts", "n_rules", "n_predicates", "n_positive", "n_negative", "longest_body", "symbols", "n_events", "n_abandoned"],
    [
        (0, 3, 2, 2, 1, True, False, True, 1, 5, 7, 4, 5, 3, 2, 2, 'R1,R1,R2,R3,R3', 3, 0),
        (1, 2, 1, 1, 1, True, False, True, 1, 3, 5, 0, 2, 1, 2, 0, 'R1,R3,R2,R4', 3, 0),
        (2, 4, 3, 2, 2, True, False, True, 2, 3, 3, 3, 3, 2, 1, 1, 'R1,R1,R3,R2,R3,R3', 4, 0),
        (3, 0, 0, 0, 0, False, True, True, 0, 2, 2, 1, 2, 1, 0, 1, '', 0, 0),
        (4, 0, 0, 0, 0, False, True, True, 0, 2, 3, 2, 4, 2, 1, 1, '', 0, 0),
        (5, 1, 0, 0, 0, False, True, True, 0, 3, 3, 1, 3, 1, 2, 2, 'R1,R2', 1, 0),
    ],
)

EXPECTED["q105_controls"] = (
    ["four_way", "at_maximum", "failures", "invariant", "untrainable"],
    [
        (0, True, True, '', True, None),
        (1, True, True, '', True, None),
        (2, True, True, '', True, None),
        (3, True, False, 'facts alone are not rewarded less', True, None),
        (4, True, False, 'facts alone are not rewarded less', True, None),
        (5, True, True, '', True, None),
        (6, False, False, 'unsolved', True, 'gen_failed'),
    ],
)

EXPECTED["q106_first_unseen"] = (
    ["first_unseen"],
    [
        (1, 6),
        (2, 7),
    ],
)

EXPECTED["q108_audit_kinds"] = (
    ["problem_id", "kind", "right", "n"],
    [
        (0, 'nixon_diamond', 'role', 1, 1),
        (0, 'nixon_diamond', 'subsume', 3, 3),
        (0, 'nixon_diamond', 'fold_candidates', 3, 3),
        (0, 'nixon_diamond', 'check', 4, 4),
        (0, 'nixon_diamond', 'reuse_scan', 3, 3),
        (0, 'nixon_diamond', 'reuse_check', 2, 2),
        (0, 'nixon_diamond', 'introduce', 2, 2),
        (0, 'nixon_diamond', 'contrary_facts', 1, 1),
        (1, 'nixon_diamond', 'role', 1, 1),
        (1, 'nixon_diamond', 'subsume', 2, 3),
        (1, 'nixon_diamond', 'fold_candidates', 2, 2),
        (1, 'nixon_diamond', 'check', 3, 3),
        (1, 'nixon_diamond', 'reuse_scan', 3, 3),
        (1, 'nixon_diamond', 'reuse_check', 1, 2),
        (1, 'nixon_diamond', 'introduce', 2, 2),
        (1, 'nixon_diamond', 'contrary_facts', 0, 1),
        (2, 'nixon_diamond', 'role', 1, 1),
        (2, 'nixon_diamond', 'subsume', 0, 3),
        (2, 'nixon_diamond', 'fold_candidates', 3, 3),
        (2, 'nixon_diamond', 'check', 4, 4),
        (2, 'nixon_diamond', 'reuse_scan', 3, 3),
        (2, 'nixon_diamond', 'reuse_check', 2, 2),
        (2, 'nixon_diamond', 'introduce', 2, 2),
        (2, 'nixon_diamond', 'contrary_facts', 1, 1),
        (3, 'nixon_diamond', 'role', 1, 1),
        (3, 'nixon_diamond', 'subsume', 3, 3),
        (3, 'nixon_diamond', 'fold_candidates', 3, 3),
        (3, 'nixon_diamond', 'check', 0, 4),
        (3, 'nixon_diamond', 'reuse_scan', 3, 3),
        (3, 'nixon_diamond', 'reuse_check', 2, 2),
        (3, 'nixon_diamond', 'introduce', 2, 2),
        (3, 'nixon_diamond', 'contrary_facts', 1, 1),
        (4, 'nixon_diamond', 'role', 1, 1),
        (4, 'nixon_diamond', 'subsume', 3, 3),
        (4, 'nixon_diamond', 'fold_candidates', 3, 3),
        (4, 'nixon_diamond', 'check', 4, 4),
        (4, 'nixon_diamond', 'reuse_scan', 3, 3),
        (4, 'nixon_diamond', 'reuse_check', 2, 2),
        (4, 'nixon_diamond', 'introduce', 2, 2),
        (4, 'nixon_diamond', 'contrary_facts', 1, 1),
        (5, 'nixon_diamond', 'role', 1, 1),
        (5, 'nixon_diamond', 'subsume', 1, 2),
        (5, 'nixon_diamond', 'fold_candidates', 1, 1),
        (5, 'nixon_diamond', 'check', 1, 2),
        (6, 'nixon_diamond', 'role', 1, 1),
        (6, 'nixon_diamond', 'subsume', 3, 3),
        (6, 'nixon_diamond', 'fold_candidates', 3, 3),
        (6, 'nixon_diamond', 'check', 0, 4),
        (6, 'nixon_diamond', 'reuse_scan', 3, 3),
        (6, 'nixon_diamond', 'reuse_check', 2, 2),
        (6, 'nixon_diamond', 'introduce', 2, 2),
        (6, 'nixon_diamond', 'contrary_facts', 1, 1),
        (8, 'flies', 'role', 1, 1),
        (8, 'flies', 'subsume', 3, 3),
        (8, 'flies', 'fold_candidates', 2, 2),
        (8, 'flies', 'check', 3, 3),
        (8, 'flies', 'reuse_scan', 2, 2),
        (8, 'flies', 'reuse_check', 1, 1),
        (8, 'flies', 'introduce', 1, 1),
        (8, 'flies', 'contrary_facts', 1, 1),
        (9, 'flies', 'role', 1, 1),
        (9, 'flies', 'subsume', 0, 1),
        (10, 'flies', 'role', 1, 1),
        (10, 'flies', 'subsume', 0, 3),
        (10, 'flies', 'fold_candidates', 2, 2),
        (10, 'flies', 'check', 3, 3),
        (10, 'flies', 'reuse_scan', 2, 2),
        (10, 'flies', 'reuse_check', 1, 1),
        (10, 'flies', 'introduce', 1, 1),
        (10, 'flies', 'contrary_facts', 1, 1),
        (11, 'flies', 'role', 1, 1),
        (11, 'flies', 'subsume', 3, 3),
        (11, 'flies', 'fold_candidates', 2, 2),
        (11, 'flies', 'check', 0, 3),
        (11, 'flies', 'reuse_scan', 2, 2),
        (11, 'flies', 'reuse_check', 1, 1),
        (11, 'flies', 'introduce', 1, 1),
        (11, 'flies', 'contrary_facts', 1, 1),
        (12, 'flies', 'role', 1, 1),
        (12, 'flies', 'subsume', 3, 3),
        (12, 'flies', 'fold_candidates', 2, 2),
        (12, 'flies', 'check', 3, 3),
        (12, 'flies', 'reuse_scan', 2, 2),
        (12, 'flies', 'reuse_check', 1, 1),
        (12, 'flies', 'introduce', 1, 1),
        (12, 'flies', 'contrary_facts', 1, 1),
        (13, 'flies', 'role', 1, 1),
        (13, 'flies', 'subsume', 1, 1),
        (13, 'flies', 'fold_candidates', 1, 1),
        (13, 'flies', 'check', 1, 2),
        (13, 'flies', 'reuse_scan', 0, 1),
        (14, 'flies', 'role', 1, 1),
        (14, 'flies', 'subsume', 3, 3),
        (14, 'flies', 'fold_candidates', 2, 2),
        (14, 'flies', 'check', 0, 3),
        (14, 'flies', 'reuse_scan', 2, 2),
        (14, 'flies', 'reuse_check', 1, 1),
        (14, 'flies', 'introduce', 1, 1),
        (14, 'flies', 'contrary_facts', 1, 1),
        (16, 'tax_law', 'role', 1, 1),
        (16, 'tax_law', 'subsume', 4, 4),
        (16, 'tax_law', 'fold_candidates', 4, 4),
        (16, 'tax_law', 'check', 5, 5),
        (16, 'tax_law', 'reuse_scan', 4, 4),
        (16, 'tax_law', 'reuse_check', 2, 2),
        (16, 'tax_law', 'introduce', 3, 3),
        (16, 'tax_law', 'contrary_facts', 2, 2),
        (17, 'tax_law', 'role', 1, 1),
        (17, 'tax_law', 'subsume', 1, 2),
        (17, 'tax_law', 'fold_candidates', 1, 1),
        (17, 'tax_law', 'check', 0, 1),
        (18, 'tax_law', 'role', 1, 1),
        (18, 'tax_law', 'subsume', 0, 4),
        (18, 'tax_law', 'fold_candidates', 4, 4),
        (18, 'tax_law', 'check', 5, 5),
        (18, 'tax_law', 'reuse_scan', 4, 4),
        (18, 'tax_law', 'reuse_check', 2, 2),
        (18, 'tax_law', 'introduce', 3, 3),
        (18, 'tax_law', 'contrary_facts', 2, 2),
        (19, 'tax_law', 'role', 1, 1),
        (19, 'tax_law', 'subsume', 4, 4),
        (19, 'tax_law', 'fold_candidates', 4, 4),
        (19, 'tax_law', 'check', 0, 5),
        (19, 'tax_law', 'reuse_scan', 4, 4),
        (19, 'tax_law', 'reuse_check', 2, 2),
        (19, 'tax_law', 'introduce', 3, 3),
        (19, 'tax_law', 'contrary_facts', 2, 2),
        (20, 'tax_law', 'role', 1, 1),
        (20, 'tax_law', 'subsume', 4, 4),
        (20, 'tax_law', 'fold_candidates', 4, 4),
        (20, 'tax_law', 'check', 5, 5),
        (20, 'tax_law', 'reuse_scan', 4, 4),
        (20, 'tax_law', 'reuse_check', 2, 2),
        (20, 'tax_law', 'introduce', 3, 3),
        (20, 'tax_law', 'contrary_facts', 2, 2),
        (21, 'tax_law', 'role', 1, 1),
        (21, 'tax_law', 'subsume', 1, 2),
        (21, 'tax_law', 'fold_candidates', 1, 1),
        (21, 'tax_law', 'check', 1, 3),
        (21, 'tax_law', 'reuse_scan', 0, 1),
        (22, 'tax_law', 'role', 1, 1),
        (22, 'tax_law', 'subsume', 4, 4),
        (22, 'tax_law', 'fold_candidates', 4, 4),
        (22, 'tax_law', 'check', 0, 5),
        (22, 'tax_law', 'reuse_scan', 4, 4),
        (22, 'tax_law', 'reuse_check', 2, 2),
        (22, 'tax_law', 'introduce', 3, 3),
        (22, 'tax_law', 'contrary_facts', 2, 2),
    ],
)

EXPECTED["q109_prose_steps"] = (
    ["has_trace", "answer_first", "steps", "precision", "recall", "f1", "align_exact", "r1_recall", "r4_recall", "phase_order_ok"],
    [
        (0, True, False, 'R1 flies(X) :- X = tweety. | R2 flies(X) :- bird(X). | R3 flies(X) :- alpha#0(X), bird(X). | R1 c_alpha#0(X) :- X = sam. | R4 c_alpha#0(X) :- X = sam.', 0.8, 0.5714, 0.6667, 0.5714, 0.6667, 0.0, True),
        (1, True, True, 'R1 flies(X) :- X = tweety. | R4 flies(X) :- X = tweety.', 0.5, 0.1429, 0.2222, 0.1429, 0.3333, 0.0, True),
        (2, False, False, '', 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, True),
        (3, False, False, '', 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, True),
        (4, True, False, 'R1 flies(X) :- X = opus. | R1 flies(X) :- X = tweety. | R2 flies(X) :- bird(X). | R4 flies(X) :- X = tweety.', 0.5, 0.2857, 0.3636, 0.2857, 0.3333, 0.0, True),
    ],
)

EXPECTED["q10_violations"] = (
    ["violation"],
    [
        (9, 'contrary of normal_bird(X) changed'),
        (9, 'head bird is background'),
        (9, 'variable Y is not bound'),
        (16, 'assumption flies is learnable'),
    ],
)

EXPECTED["q111_course_events"] = (
    ["event_id", "idx", "input_rule", "outcome", "abandoned", "chosen_rank", "guarded_rule", "contrary_facts", "n_candidates", "n_attempts"],
    [
        (0, 0, 0, 'pacifist(X) :- X = c.', 'folded', False, 0, None, '', 2, 0),
        (0, 1, 1, 'abnormal_quaker(X) :- X = b.', 'folded_with_assumption', False, 1, 'abnormal_quaker(X) :- republican(X), alpha_0(X).', 'c_alpha_0(X) :- X = a.', 3, 2),
        (0, 2, 2, 'c_alpha_0(X) :- X = a.', 'folded_with_assumption', False, 0, 'c_alpha_0(X) :- quaker(X), normal_quaker(X).', '', 3, 1),
        (1, 0, 0, 'flies(X) :- X = tweety.', 'folded_with_assumption', False, 0, 'flies(X) :- bird(X), alpha_0(X).', 'c_alpha_0(X) :- X = sam. c_alpha_0(X) :- X = opus.', 2, 1),
        (1, 1, 1, 'c_alpha_0(X) :- X = sam.', 'folded', False, 1, None, '', 3, 1),
        (1, 2, 2, 'c_alpha_0(X) :- X = opus.', 'subsumed', False, None, None, '', 0, 0),
        (2, 0, 0, 'taxable(X) :- X = alice.', 'folded_with_assumption', False, 0, 'taxable(X) :- employed(X), alpha_0(X).', 'c_alpha_0(X) :- X = bob.', 2, 1),
        (2, 1, 1, 'taxable(X) :- X = carol.', 'folded', False, 0, None, '', 2, 0),
        (2, 2, 2, 'c_alpha_0(X) :- X = bob.', 'folded_with_assumption', False, 1, 'c_alpha_0(X) :- dom(X), alpha_1(X).', 'c_alpha_1(X) :- X = alice.', 2, 2),
        (2, 3, 3, 'c_alpha_1(X) :- X = alice.', 'folded_with_assumption', False, 0, 'c_alpha_1(X) :- employed(X), alpha_0(X).', '', 2, 1),
        (5, 0, 0, 'chief(X) :- X = a.', 'folded', False, 0, None, '', 2, 0),
    ],
)

EXPECTED["q36_line_classifier"] = (
    ["kind"],
    [
        (0, 'role'),
        (1, 'role'),
        (2, 'gen'),
        (3, 'rote'),
        (4, 'other'),
        (5, 'fact'),
        (6, 'subsume'),
        (7, 'subsume'),
        (8, 'other'),
        (9, 'intensional'),
        (10, 'candidates'),
        (11, 'candidates'),
        (12, 'check'),
        (13, 'other'),
        (14, 'fold'),
        (15, 'guard_on'),
        (16, 'scan'),
        (17, 'reuse'),
        (18, 'failed'),
        (19, 'no_facts'),
        (20, 'guard'),
        (21, 'declare'),
        (22, 'gave_up'),
        (23, 'done'),
        (24, 'subsume'),
        (25, 'other'),
        (26, 'other'),
        (27, 'other'),
        (28, 'done'),
        (29, 'other'),
    ],
)

EXPECTED["q37_rule_parse"] = (
    ["is_rule", "head", "n_body", "body", "constants", "intensional", "is_ground", "predicate", "unsafe", "key"],
    [
        (0, True, 'p(X)', 2, 'q(X)|notr(X)', '', True, False, 'p', '', 'p(V0):-notr(V0),q(V0)'),
        (1, True, 'fact(a)', 0, '', 'a', False, True, 'fact', '', 'fact(a):-'),
        (2, True, 'flag', 0, '', '', True, True, 'flag', '', 'flag:-'),
        (3, False, None, None, None, None, None, None, None, None, None),
        (4, True, 'p(X)', 1, 'X=c', 'c', False, False, 'p', '', 'p(V0):-V0=c'),
        (5, True, 's(X,Y)', 2, 't(X)|Y>3', '', True, False, 's', 'Y', 's(V0,V1):-V1>3,t(V0)'),
        (6, False, None, None, None, None, None, None, None, None, None),
        (7, True, 'w(X)', 2, 'v(X)|u(X,b)', 'b', False, False, 'w', '', 'w(V0):-u(V0,b),v(V0)'),
        (8, True, 'm(X)', 3, 'n(Y)|X=Y|Z!=2', '2', False, False, 'm', 'Z', 'm(V0):-V1!=2,V0=V2,n(V2)'),
        (9, False, None, None, None, None, None, None, None, None, None),
        (10, False, None, None, None, None, None, None, None, None, None),
        (11, True, 'v(A,B)', 2, 'e(B,A)|dom(A)', '', True, False, 'v', '', 'v(V0,V1):-dom(V0),e(V1,V0)'),
        (12, True, 'spaced(X)', 1, 'q(X)', '', True, False, 'spaced', '', 'spaced(V0):-q(V0)'),
        (13, True, 'h(X)', 3, 'notg(X)|X=Y|Y=d', 'd', False, False, 'h', '', 'h(V0):-V0=V1,V1=d,notg(V0)'),
    ],
)

EXPECTED["q54_learner_on_builtins"] = (
    ["success", "n_steps", "symbols", "rules", "assumptions", "n_backtracks", "budget_exceeded", "error"],
    [
        (0, True, 5, 'R1,R1,R2,R3,R3', 'pacifist(X) :- democrat(X). abnormal_quaker(X) :- republican(X), alpha_0(X). c_alpha_0(X) :- quaker(X), normal_quaker(X).', 'alpha_0(X)', 0, False, None),
        (1, True, 4, 'R1,R3,R2,R4', 'flies(X) :- bird(X), alpha_0(X). c_alpha_0(X) :- penguin(X).', 'alpha_0(X)', 0, False, None),
        (2, True, 6, 'R1,R1,R3,R2,R3,R3', 'taxable(X) :- employed(X), alpha_0(X). taxable(X) :- self_employed(X). c_alpha_0(X) :- dom(X), alpha_1(X). c_alpha_1(X) :- employed(X), alpha_0(X).', 'alpha_0(X),alpha_1(X)', 0, False, None),
        (3, True, 0, '', '', '', 0, False, None),
        (4, True, 0, '', '', '', 0, False, None),
        (5, True, 2, 'R1,R2', 'chief(X) :- old(X).', '', 0, False, None),
        (6, False, 0, '', '', '', 0, False, None),
    ],
)

EXPECTED["q55_replay"] = (
    ["n_lines", "rules", "assumptions", "same"],
    [
        (0, 34, 'pacifist(X) :- democrat(X). abnormal_quaker(X) :- republican(X), alpha_0(X). c_alpha_0(X) :- quaker(X), normal_quaker(X).', 'alpha_0(X) defeated_by c_alpha_0(X), normal_quaker(X) defeated_by abnormal_quaker(X)', True),
        (1, 27, 'flies(X) :- bird(X), alpha_0(X). c_alpha_0(X) :- penguin(X).', 'alpha_0(X) defeated_by c_alpha_0(X)', True),
        (2, 44, 'taxable(X) :- employed(X), alpha_0(X). taxable(X) :- self_employed(X). c_alpha_0(X) :- dom(X), alpha_1(X). c_alpha_1(X) :- employed(X), alpha_0(X).', 'alpha_0(X) defeated_by c_alpha_0(X), alpha_1(X) defeated_by c_alpha_1(X)', True),
        (3, 3, '', '', True),
        (4, 3, '', '', True),
        (5, 9, 'chief(X) :- old(X).', '', True),
    ],
)

EXPECTED["q56_audit_trace"] = (
    ["problem_id", "n_decisions", "accuracy", "written_accuracy", "n_omitted", "n_illegal", "first_error", "gave_up", "answer_matches_trace", "gold_prefix"],
    [
        (0, 'nixon_diamond', 19, 1.0, 1.0, 0, 0, None, 0, True, 1.0),
        (1, 'nixon_diamond', 17, 0.8235, 0.8235, 0, 4, 6, 0, False, 0.1471),
        (2, 'nixon_diamond', 19, 0.8421, 1.0, 3, 0, 6, 0, True, 0.1471),
        (3, 'nixon_diamond', 19, 0.7895, 1.0, 4, 0, 8, 0, True, 0.2059),
        (4, 'nixon_diamond', 19, 1.0, 1.0, 0, 0, None, 0, True, 0.0),
        (5, 'nixon_diamond', 6, 0.6667, 1.0, 2, 1, 8, 0, False, 0.2353),
        (6, 'nixon_diamond', 19, 0.7895, 1.0, 4, 4, 8, 0, False, 0.2059),
        (7, 'nixon_diamond', None, None, None, None, None, None, None, None, None),
        (8, 'flies', 14, 1.0, 1.0, 0, 0, None, 0, True, 1.0),
        (9, 'flies', 2, 0.5, 0.5, 0, 20, 5, 0, False, 0.1481),
        (10, 'flies', 14, 0.7857, 1.0, 3, 1, 5, 0, False, 0.1481),
        (11, 'flies', 14, 0.7857, 1.0, 3, 0, 7, 0, True, 0.2222),
        (12, 'flies', 14, 1.0, 1.0, 0, 0, None, 0, True, 0.0),
        (13, 'flies', 6, 0.6667, 1.0, 2, 0, 8, 0, False, 0.2963),
        (14, 'flies', 14, 0.7857, 1.0, 3, 3, 7, 0, False, 0.2222),
        (15, 'flies', None, None, None, None, None, None, None, None, None),
        (16, 'tax_law', 25, 1.0, 1.0, 0, 0, None, 0, True, 1.0),
        (17, 'tax_law', 5, 0.6, 0.6, 0, 31, 6, 0, False, 0.1136),
        (18, 'tax_law', 25, 0.84, 1.0, 4, 0, 6, 0, True, 0.1136),
        (19, 'tax_law', 25, 0.8, 1.0, 5, 0, 8, 0, True, 0.1591),
        (20, 'tax_law', 25, 1.0, 1.0, 0, 0, None, 0, True, 0.0),
        (21, 'tax_law', 8, 0.5, 1.0, 4, 0, 8, 0, False, 0.1818),
        (22, 'tax_law', 25, 0.8, 1.0, 5, 5, 8, 0, False, 0.1591),
        (23, 'tax_law', None, None, None, None, None, None, None, None, None),
    ],
)

EXPECTED["q73_attempt_verdict"] = (
    ["tier", "class", "attempts", "accepted", "duplicates", "duplicate_rate", "other_rejects"],
    [
        ('t1_base', 'defeasible', 6, 6, 0, 0.0, 0),
        ('t1_base', 'monotonic', 6, 6, 0, 0.0, 0),
        ('t4_nested', 'defeasible', 6, 6, 0, 0.0, 0),
        ('t4_nested', 'monotonic', 6, 6, 0, 0.0, 0),
        ('t5_twopath', 'defeasible', 6, 6, 0, 0.0, 0),
        ('t5_twopath', 'monotonic', 6, 6, 0, 0.0, 0),
        ('t8_decoy', 'decoy_first', 6, 5, 1, 0.1667, 0),
        ('t8_decoy', 'key_first', 6, 6, 0, 0.0, 0),
        ('t9_reuse', 'reuse_fails', 6, 6, 0, 0.0, 0),
        ('t9_reuse', 'reuse_ok', 6, 6, 0, 0.0, 0),
    ],
)

EXPECTED["q86_surface_cues"] = (
    ["cue", "n", "signal"],
    [
        ('exception_on_keyed', 32, 0.5),
        ('exception_on_negative', 32, 0.5),
        ('exception_on_unlisted', 32, 0.5),
        ('exceptions_exist', 32, 0.5),
        ('more_negatives', 32, 0.5313),
        ('negative_is_keyed', 32, 0.9063),
        ('several_exceptions', 32, 0.5),
    ],
)

EXPECTED["q89_answer_parser"] = (
    ["parsed", "rules", "assumptions", "repairs"],
    [
        (0, True, 'flies(X) :- bird(X), alpha_0(X). c_alpha_0(X) :- penguin(X).', 'alpha_0(X) defeated_by c_alpha_0(X)', ''),
        (1, True, 'flies(Bird) :- bird(Bird), usual(Bird). c_usual(Bird) :- penguin(Bird).', 'usual(Bird) defeated_by c_usual(Bird)', ''),
        (2, True, 'flies(X) :- bird(X), alpha_0(X). c_alpha_0(X) :- penguin(X).', 'alpha_0(X) defeated_by c_alpha_0(X)', ''),
        (3, True, '', '', 'empty answer'),
        (4, True, 'flies(X) :- X = tweety.', '', ''),
        (5, True, 'flies(tweety).', '', ''),
        (6, True, 'flies(X) :- bird(X).', '', ''),
        (7, False, None, None, None),
        (8, False, None, None, None),
        (9, True, 'bird(X) :- penguin(X). flies(Y) :- bird(X).', 'normal_bird(X) defeated_by other(X)', ''),
        (10, True, 'flies(X) :- bird(X), normal_bird(X). ab_bird(X) :- penguin(X).', 'normal_bird(X) defeated_by ab_bird(X)', ''),
        (11, True, 'flies(X) :- bird(X), alpha_0(X). c_alpha_0(X) :- penguin(X).', 'alpha_0(X) defeated_by c_alpha_0(X)', '2 answer blocks'),
        (12, True, 'flies(X) :- bird(X), alpha_0(X). c_alpha_0(X) :- penguin(X).', 'alpha_0(X) defeated_by c_alpha_0(X)', '2 answer blocks; echo of the question dropped; block 1 taken'),
        (13, True, 'flies(X) :- bird(X), usual(X). odd(X) :- penguin(X).', 'usual(X) defeated_by odd(X)', '2 rules among the assumptions'),
        (14, True, 'flies(X) :- bird(X), usual(X). odd(X) :- penguin(X).', 'usual(X) defeated_by odd(X)', '1 lines with an arrow that are no rules'),
        (15, True, 'flies(X) :- bird(X), alpha_0(X). c_alpha_0(X) :- penguin(X). flies(X) :- bird(X), never(X).', 'alpha_0(X) defeated_by c_alpha_0(X), never(X) defeated_by bird(X)', '1 rules among the assumptions'),
        (16, True, '', 'flies(tweety) defeated_by c_flies(tweety)', ''),
        (17, True, 'flies(X) :- bird(X), alpha_0(X), bird(Y). c_alpha_0(X) :- penguin(X).', 'alpha_0(X) defeated_by c_alpha_0(X)', ''),
        (18, False, None, None, None),
        (19, False, None, None, None),
        (20, True, 'p(X) :- q(X,a), r(X).', '', ''),
        (21, True, 'p(X) :- q(X).', 'a(X) defeated_by c(X)', ''),
        (22, True, '', 'a(X) defeated_by c(X)', ''),
        (23, True, 'p(X) :- q(X). r(X).', '', ''),
    ],
)

EXPECTED["q90_score_cards"] = (
    ["parsed", "well_formed", "valid", "stable", "intensional", "clean", "exact", "agreement", "n_ground", "n_self_defeating", "defeasible", "ref_defeasible", "r2_n", "r2_exact", "r2_over", "r2_under", "r2_other", "violations", "error", "reward"],
    [
        (0, True, True, True, True, True, True, True, None, 0, 0, True, True, 2, 2, 0, 0, 0, '', 'ok', 1.5),
        (1, True, True, True, True, True, True, True, None, 0, 0, True, True, 2, 2, 0, 0, 0, '', 'ok', 1.5),
        (2, True, True, True, True, True, True, True, None, 0, 0, True, True, 2, 2, 0, 0, 0, '', 'ok', 1.5),
        (3, True, True, False, True, True, False, False, None, 0, 0, False, True, 0, 0, 0, 0, 0, '', 'not_a_solution', 0.0),
        (4, True, True, True, True, False, False, False, None, 1, 0, False, True, 1, 0, 0, 1, 0, '', 'valid_but_degenerate', 0.9),
        (5, True, True, True, True, False, False, False, None, 1, 0, False, True, 1, 0, 0, 1, 0, '', 'valid_but_degenerate', 0.9),
        (6, True, True, False, True, True, False, False, None, 0, 0, False, True, 1, 1, 0, 0, 0, '', 'not_a_solution', 0.0),
        (7, False, None, None, None, None, None, None, None, None, None, None, True, None, None, None, None, None, None, 'parse_error', 0.0),
        (8, False, None, None, None, None, None, None, None, None, None, None, True, None, None, None, None, None, None, 'parse_error', 0.0),
        (9, True, False, False, True, True, False, False, None, 0, 0, False, True, 1, 1, 0, 0, 0, 'head bird is background; variable Y is not bound; contrary of normal_bird(X) changed', 'illformed', 0.0),
        (10, True, True, True, True, True, True, False, None, 0, 0, True, True, 1, 1, 0, 0, 0, '', 'ok', 1.5),
        (11, True, True, True, True, True, True, True, None, 0, 0, True, True, 2, 2, 0, 0, 0, '', 'ok', 1.5),
        (12, True, True, True, True, True, True, True, None, 0, 0, True, True, 2, 2, 0, 0, 0, '', 'ok', 1.5),
        (13, True, True, True, True, True, True, True, None, 0, 0, True, True, 2, 2, 0, 0, 0, '', 'ok', 1.5),
        (14, True, True, True, True, True, True, True, None, 0, 0, True, True, 2, 2, 0, 0, 0, '', 'ok', 1.5),
        (15, True, True, True, True, True, False, False, None, 0, 1, True, True, 1, 1, 0, 0, 0, '', 'self_defeating', 1.0),
        (16, True, False, True, True, True, False, False, None, 0, 0, False, True, 0, 0, 0, 0, 0, 'assumption flies is learnable', 'illformed', 0.0),
        (17, True, True, True, True, True, True, False, None, 0, 0, True, True, 2, 2, 0, 0, 0, '', 'ok', 1.5),
    ],
)

EXPECTED["q91_corpus_build"] = (
    ["tier", "class", "split", "n"],
    [
        ('t1_base', 'defeasible', 'test', 1),
        ('t1_base', 'defeasible', 'train', 2),
        ('t1_base', 'defeasible', 'val', 1),
        ('t1_base', 'monotonic', 'test', 1),
        ('t1_base', 'monotonic', 'train', 2),
        ('t1_base', 'monotonic', 'val', 1),
        ('t4_nested', 'defeasible', 'test', 1),
        ('t4_nested', 'defeasible', 'train', 2),
        ('t4_nested', 'defeasible', 'val', 1),
        ('t4_nested', 'monotonic', 'test', 1),
        ('t4_nested', 'monotonic', 'train', 2),
        ('t4_nested', 'monotonic', 'val', 1),
        ('t5_twopath', 'defeasible', 'test', 1),
        ('t5_twopath', 'defeasible', 'train', 2),
        ('t5_twopath', 'defeasible', 'val', 1),
        ('t5_twopath', 'monotonic', 'test', 1),
        ('t5_twopath', 'monotonic', 'train', 2),
        ('t5_twopath', 'monotonic', 'val', 1),
        ('t8_decoy', 'decoy_first', 'heldout', 2),
        ('t8_decoy', 'key_first', 'heldout', 2),
        ('t9_reuse', 'reuse_fails', 'heldout', 2),
        ('t9_reuse', 'reuse_ok', 'heldout', 2),
    ],
)

EXPECTED["q92_decision_rows"] = (
    ["k", "kind", "event", "src", "rank", "first", "extra", "cell", "verdict", "witness", "target"],
    [
        (0, 0, 'role', -1, 'role', None, False, False, 'other', None, None, 'R1 pacifist(X) :- X = c.\nR1 abnormal_quaker(X) :- X = b.'),
        (0, 1, 'subsume', 0, 'role', None, False, False, 'other', False, None, 'fails: unknown. no.'),
        (0, 2, 'fold_candidates', 0, 'role', None, False, False, 'other', None, None, 'R2 candidates: [pacifist(X) :- democrat(X).] [pacifist(X) :- dom(X).]'),
        (0, 3, 'check', 0, 'role', 0, True, False, 'first_check', True, None, 'fails: none. yes.'),
        (0, 4, 'subsume', 1, 'role', None, False, False, 'later_role_subsume', False, None, 'fails: unknown. no.'),
        (0, 5, 'fold_candidates', 1, 'role', None, False, False, 'other', None, None, 'R2 candidates: [abnormal_quaker(X) :- quaker(X).] [abnormal_quaker(X) :- republican(X).] [abnormal_quaker(X) :- dom(X).]'),
        (0, 6, 'check', 1, 'role', 0, False, False, 'second_path_check', False, None, 'fails: unknown. no.'),
        (0, 7, 'reuse_scan', 1, 'role', None, False, False, 'other', None, None, 'R3 reuse: [normal_quaker(X)].'),
        (0, 8, 'reuse_check', 1, 'role', None, False, False, 'role_reuse_check', False, None, 'no.'),
        (0, 9, 'check', 1, 'role', 1, False, False, 'after_l39_check', False, None, 'fails: unknown. no.'),
        (0, 10, 'reuse_scan', 1, 'role', None, False, False, 'other', None, None, 'R3 reuse: none.'),
        (0, 11, 'contrary_facts', 1, 'role', None, False, False, 'other', None, None, 'R1 c_alpha_0(X) :- X = a.'),
        (0, 12, 'subsume', 2, 'contrary', None, False, False, 'other', False, None, 'fails: unknown. no.'),
        (0, 13, 'fold_candidates', 2, 'contrary', None, False, False, 'other', None, None, 'R2 candidates: [c_alpha_0(X) :- quaker(X).] [c_alpha_0(X) :- republican(X).] [c_alpha_0(X) :- dom(X).]'),
        (0, 14, 'check', 2, 'contrary', 1, False, True, 'extra_check', False, None, 'fails: unknown. no.'),
        (0, 15, 'check', 2, 'contrary', 0, False, False, 'other', False, None, 'fails: unknown. no.'),
        (0, 16, 'reuse_scan', 2, 'contrary', None, False, False, 'other', None, None, 'R3 reuse: [normal_quaker(X)].'),
        (0, 17, 'reuse_check', 2, 'contrary', None, False, False, 'other', True, None, 'yes.'),
        (1, 0, 'role', -1, 'role', None, False, False, 'other', None, None, 'R1 flies(X) :- X = tweety.'),
        (1, 1, 'subsume', 0, 'role', None, False, False, 'other', False, 'flies(tweety)', 'fails: flies(tweety). no.'),
        (1, 2, 'fold_candidates', 0, 'role', None, False, False, 'other', None, None, 'R2 candidates: [flies(X) :- bird(X).] [flies(X) :- dom(X).]'),
        (1, 3, 'check', 0, 'role', 0, True, False, 'first_check', False, 'flies(sam) flies(opus)', 'fails: flies(sam), flies(opus). no.'),
        (1, 4, 'reuse_scan', 0, 'role', None, False, False, 'other', None, None, 'R3 reuse: none.'),
        (1, 5, 'contrary_facts', 0, 'role', None, False, False, 'other', None, None, 'R1 c_alpha_0(X) :- X = sam.\nR1 c_alpha_0(X) :- X = opus.'),
        (1, 6, 'subsume', 1, 'contrary', None, False, False, 'other', False, 'flies(sam)', 'fails: flies(sam). no.'),
        (1, 7, 'fold_candidates', 1, 'contrary', None, False, False, 'other', None, None, 'R2 candidates: [c_alpha_0(X) :- bird(X).] [c_alpha_0(X) :- penguin(X).] [c_alpha_0(X) :- dom(X).]'),
        (1, 8, 'check', 1, 'contrary', 0, False, False, 'other', False, 'flies(tweety)', 'fails: flies(tweety). no.'),
        (1, 9, 'reuse_scan', 1, 'contrary', None, False, False, 'other', None, None, 'R3 reuse: [alpha_0(X)].'),
        (1, 10, 'reuse_check', 1, 'contrary', None, False, False, 'other', False, None, 'no.'),
        (1, 11, 'check', 1, 'contrary', 1, False, False, 'other', True, '', 'fails: none. yes.'),
        (1, 12, 'subsume', 2, 'contrary', None, False, False, 'other', True, '', 'fails: none. yes.'),
        (2, 0, 'role', -1, 'role', None, False, False, 'other', None, None, 'R1 taxable(X) :- X = alice.\nR1 taxable(X) :- X = carol.'),
        (2, 1, 'subsume', 0, 'role', None, False, False, 'other', False, 'taxable(alice)', 'fails: taxable(alice). no.'),
        (2, 2, 'fold_candidates', 0, 'role', None, False, False, 'other', None, None, 'R2 candidates: [taxable(X) :- employed(X).] [taxable(X) :- dom(X).]'),
        (2, 3, 'check', 0, 'role', 0, True, False, 'first_check', False, 'taxable(bob)', 'fails: taxable(bob). no.'),
        (2, 4, 'reuse_scan', 0, 'role', None, False, False, 'other', None, None, 'R3 reuse: none.'),
        (2, 5, 'contrary_facts', 0, 'role', None, False, False, 'other', None, None, 'R1 c_alpha_0(X) :- X = bob.'),
        (2, 6, 'subsume', 1, 'role', None, False, False, 'later_role_subsume', False, 'taxable(carol)', 'fails: taxable(carol). no.'),
        (2, 7, 'fold_candidates', 1, 'role', None, False, False, 'other', None, None, 'R2 candidates: [taxable(X) :- self_employed(X).] [taxable(X) :- dom(X).]'),
        (2, 8, 'check', 1, 'role', 0, False, False, 'second_path_check', True, '', 'fails: none. yes.'),
        (2, 9, 'subsume', 2, 'contrary', None, False, False, 'other', False, 'taxable(bob)', 'fails: taxable(bob). no.'),
        (2, 10, 'fold_candidates', 2, 'contrary', None, False, False, 'other', None, None, 'R2 candidates: [c_alpha_0(X) :- employed(X).] [c_alpha_0(X) :- dom(X).]'),
        (2, 11, 'check', 2, 'contrary', 0, False, False, 'other', False, 'taxable(alice)', 'fails: taxable(alice). no.'),
        (2, 12, 'reuse_scan', 2, 'contrary', None, False, False, 'other', None, None, 'R3 reuse: [alpha_0(X)].'),
        (2, 13, 'reuse_check', 2, 'contrary', None, False, False, 'other', False, None, 'no.'),
        (2, 14, 'check', 2, 'contrary', 1, False, False, 'other', False, 'taxable(alice)', 'fails: taxable(alice). no.'),
        (2, 15, 'reuse_scan', 2, 'contrary', None, False, False, 'other', None, None, 'R3 reuse: none.'),
        (2, 16, 'contrary_facts', 2, 'contrary', None, False, False, 'other', None, None, 'R1 c_alpha_1(X) :- X = alice.'),
        (2, 17, 'subsume', 3, 'contrary', None, False, False, 'other', False, 'taxable(alice)', 'fails: taxable(alice). no.'),
        (2, 18, 'fold_candidates', 3, 'contrary', None, False, False, 'other', None, None, 'R2 candidates: [c_alpha_1(X) :- employed(X).] [c_alpha_1(X) :- dom(X).]'),
        (2, 19, 'check', 3, 'contrary', 0, False, False, 'other', False, 'taxable(bob)', 'fails: taxable(bob). no.'),
        (2, 20, 'reuse_scan', 3, 'contrary', None, False, False, 'other', None, None, 'R3 reuse: [alpha_0(X)].'),
        (2, 21, 'reuse_check', 3, 'contrary', None, False, False, 'other', True, None, 'yes.'),
        (3, 0, 'role', -1, 'role', None, False, False, 'other', None, None, 'none.'),
        (4, 0, 'role', -1, 'role', None, False, False, 'other', None, None, 'none.'),
        (5, 0, 'role', -1, 'role', None, False, False, 'other', None, None, 'R1 chief(X) :- X = a.'),
        (5, 1, 'subsume', 0, 'role', None, False, False, 'other', False, 'chief(a)', 'fails: chief(a). no.'),
        (5, 2, 'fold_candidates', 0, 'role', None, False, False, 'other', None, None, 'R2 candidates: [chief(X) :- old(X).] [chief(X) :- dom(X).]'),
        (5, 3, 'check', 0, 'role', 0, True, False, 'first_check', True, '', 'fails: none. yes.'),
        (6, 0, 'role', -1, 'role', None, False, False, 'other', None, None, '(no answer)'),
    ],
)

EXPECTED["q93_policy_run_stats"] = (
    ["kind", "n", "accuracy", "accuracy_on_path", "balanced", "unusable", "first_errors"],
    [
        ('check', 55, 0.7273, None, 0.5, 0, 0),
        ('contrary_facts', 16, 0.0, None, None, 0, 0),
        ('fold_candidates', 39, 0.0, None, None, 39, 0),
        ('reuse_check', 20, 0.6, None, 0.5, 0, 0),
        ('reuse_scan', 36, 0.0, None, None, 36, 0),
        ('role', 25, 0.4, 0.4, None, 0, 15),
        ('subsume', 43, 0.907, None, 0.5, 0, 0),
    ],
)

EXPECTED["q94_example_outcomes"] = (
    ["atom", "label", "status", "narrative"],
    [
        (0, 'pacifist(a)', 'pos', 'ALWAYS', 'democrat is pacifist. republican is abnormal_quaker, unless c_alpha_0. quaker is c_alpha_0, unless abnormal_quaker.'),
        (0, 'pacifist(b)', 'neg', 'NEVER', 'democrat is pacifist. republican is abnormal_quaker, unless c_alpha_0. quaker is c_alpha_0, unless abnormal_quaker.'),
        (0, 'pacifist(c)', 'pos', 'ALWAYS', 'democrat is pacifist. republican is abnormal_quaker, unless c_alpha_0. quaker is c_alpha_0, unless abnormal_quaker.'),
        (0, 'pacifist(d)', 'neg', 'NEVER', 'democrat is pacifist. republican is abnormal_quaker, unless c_alpha_0. quaker is c_alpha_0, unless abnormal_quaker.'),
        (0, 'pacifist(e)', 'pos', 'ALWAYS', 'democrat is pacifist. republican is abnormal_quaker, unless c_alpha_0. quaker is c_alpha_0, unless abnormal_quaker.'),
        (1, 'flies(opus)', 'neg', 'NEVER', 'bird is flies, unless c_alpha_0. penguin is c_alpha_0.'),
        (1, 'flies(sam)', 'neg', 'NEVER', 'bird is flies, unless c_alpha_0. penguin is c_alpha_0.'),
        (1, 'flies(tweety)', 'pos', 'ALWAYS', 'bird is flies, unless c_alpha_0. penguin is c_alpha_0.'),
        (2, 'taxable(alice)', 'pos', 'ALWAYS', 'employed is taxable, unless c_alpha_0. self_employed is taxable. dom is c_alpha_0, unless c_alpha_1. employed is c_alpha_1, unless c_alpha_0.'),
        (2, 'taxable(bob)', 'neg', 'NEVER', 'employed is taxable, unless c_alpha_0. self_employed is taxable. dom is c_alpha_0, unless c_alpha_1. employed is c_alpha_1, unless c_alpha_0.'),
        (2, 'taxable(carol)', 'pos', 'ALWAYS', 'employed is taxable, unless c_alpha_0. self_employed is taxable. dom is c_alpha_0, unless c_alpha_1. employed is c_alpha_1, unless c_alpha_0.'),
        (3, 'flies(a)', 'pos', 'ALWAYS', ''),
        (4, 'left(a)', 'pos', 'ALWAYS', ''),
        (4, 'left(b)', 'neg', 'NEVER', ''),
        (4, 'right(b)', 'pos', 'ALWAYS', ''),
        (5, 'chief(a)', 'pos', 'ALWAYS', 'old is chief.'),
        (5, 'chief(b)', 'neg', 'NEVER', 'old is chief.'),
        (5, 'chief(c)', 'neg', 'NEVER', 'old is chief.'),
        (6, 'x(a)', 'pos', 'NEVER', 'No rules explain the examples.'),
    ],
)

EXPECTED["q95_convergence"] = (
    ["kernel", "init", "n", "rate", "mean_steps"],
    [
        ('min-dfquad', 0.5, 80, 1.0, 4.025),
        ('min-dfquad', 0.9, 80, 1.0, 16.9125),
        ('min-qe', 0.5, 80, 1.0, 2.9125),
        ('min-qe', 0.9, 80, 1.0, 4.5125),
        ('prod-dfquad', 0.5, 80, 1.0, 3.875),
        ('prod-dfquad', 0.9, 80, 1.0, 15.8375),
        ('prod-qe', 0.5, 80, 1.0, 2.8375),
        ('prod-qe', 0.9, 80, 1.0, 4.4375),
    ],
)

EXPECTED["q97_crisp_against_graded"] = (
    ["atom", "label", "crisp", "strength", "agree"],
    [
        (0, 'pacifist(a)', 'pos', 'FREE', 0.3333, False),
        (0, 'pacifist(b)', 'neg', 'FREE', 0.3333, False),
        (0, 'pacifist(c)', 'pos', 'ALWAYS', 1.0, True),
        (0, 'pacifist(d)', 'neg', 'NEVER', 0.0, True),
        (0, 'pacifist(e)', 'pos', 'FREE', 0.4545, False),
        (1, 'flies(opus)', 'neg', 'NEVER', 0.0, True),
        (1, 'flies(sam)', 'neg', 'NEVER', 0.0, True),
        (1, 'flies(tweety)', 'pos', 'ALWAYS', 0.5, True),
        (2, 'taxable(alice)', 'pos', 'FREE', 0.3333, False),
        (2, 'taxable(bob)', 'neg', 'FREE', 0.3333, False),
        (2, 'taxable(carol)', 'pos', 'ALWAYS', 1.0, True),
        (3, 'flies(a)', 'pos', 'ALWAYS', 1.0, True),
        (4, 'left(a)', 'pos', 'FREE', 0.3333, False),
        (4, 'left(b)', 'neg', 'FREE', 0.3333, False),
        (4, 'right(b)', 'pos', 'FREE', 0.3333, False),
        (5, 'chief(a)', 'pos', 'ALWAYS', 1.0, True),
        (5, 'chief(b)', 'neg', 'NEVER', 0.0, True),
        (5, 'chief(c)', 'neg', 'NEVER', 0.0, True),
        (6, 'x(a)', 'neg', 'NEVER', 0.0, True),
        (6, 'x(a)', 'pos', 'NEVER', 0.0, True),
    ],
)

EXPECTED["q98_permuted_problems"] = (
    ["symbols", "permuted_symbols", "same"],
    [
        (0, 'R1,R1,R2,R3,R3', 'R1,R1,R2,R3,R3', True),
        (1, 'R1,R3,R2,R4', 'R1,R3,R2,R4', True),
        (2, 'R1,R1,R3,R2,R3,R3', 'R1,R1,R3,R2,R3,R3', True),
        (3, '', '', True),
        (4, '', '', True),
        (5, 'R1,R2', 'R1,R2', True),
        (6, '', '', True),
    ],
)
