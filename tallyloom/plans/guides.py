"""The long guides that some prompt styles open with."""

from __future__ import annotations

# Prompts depend on these words and their order. What each level of a dimension looks like; a dimension's code is
# TRUNK- and its number in this order, in two digits.
LEVELS = {
    "problem_decomposition": "1: No subproblems identified. 2: Incomplete/disorganized parts. 3: Clear parts described in plain language. 4: Prioritizes and maps dependencies. 5: Hierarchical, top-down planning.",
    "sequencing": "1: Random/wrong order. 2: One critical step misordered. 3: Entire sequence logical and correct. 4: Efficient, avoids unnecessary steps. 5: Optimal, adaptable ordering.",
    "loops": "1: Duplicates blocks instead of looping. 2: Wrong counts or infinite loops. 3: Proper repeat/repeat-until loops. 4: Chooses optimal loop types. 5: Handles edge cases; nests correctly.",
    "conditionals": "1: No conditional blocks used. 2: Simple if; struggles with else/logic. 3: Correct if/else branches. 4: Uses AND/OR; handles edge cases. 5: Elegant logic, no redundancy.",
    "variables": "1: All values hardcoded. 2: Uninitialized or poorly named variables. 3: Updates variables properly on events. 4: Dynamic state tracking and resets. 5: Coherent system of interdependent states.",
    "event_handling": "1: Only uses green flag. 2: Misses keys or duplicates handlers. 3: Multi-event responses on correct sprites. 4: Clear, independent event architecture. 5: Coordinated flows; no timing conflicts.",
    "debugging": "1: Random changes; no visible strategy. 2: Finds simple bugs; misses logic errors. 3: Displays variables, isolates code. 4: Fixes subtle logic/edge cases. 5: Methodical testing; documents via comments.",
    "procedures": "1: No custom blocks ('My Blocks'). 2: Custom blocks lack parameters/consistency. 3: Parameterized, reusable custom block. 4: Library of blocks reducing duplication. 5: Elegant abstraction with default values.",
    "coordinates": "1: Drag-and-drop placement only. 2: Fixed, hardcoded coordinate blocks. 3: Moves sprites absolutely and incrementally. 4: Math-based boundaries and tracking. 5: Grids or advanced movement trajectories.",
    "cloning": "1: Manual sprite duplication only. 2: Clones lack independent behavior or deletion. 3: Creates and deletes clones correctly. 4: Manages lifecycles and clone limits. 5: Complex systems (waves, particles).",
    "collision": "1: No interaction detection. 2: Out-of-loop checks cause missed frames. 3: Reliable sprite/edge collision events. 4: Checks sprite, edge, and color types. 5: Accounts for size, timing, and multi-outcomes.",
    "animation": "1: Static sprites. 2: Poor timing or gameplay interference. 3: Smooth costume loops with wait blocks. 4: Linked to events (move, hit). 5: State-driven systems (idle, walk, jump).",
    "sound": "1: No audio blocks. 2: Bad timing or overlapping tracks. 3: Event-triggered, contextual audio. 4: Manages music vs. sound effects correctly. 5: Layered, balanced audio system.",
    "ui_feedback": "1: Missing score/lives/timer. 2: Cluttered, overlapping, or broken counters. 3: Real-time updates of main stats. 4: Includes start, end, and feedback screens. 5: Polished text, audio, and visual states.",
    "lists": "1: Uses single variables instead of a list. 2: Hardcoded indices; no loop traversal. 3: Basic operations (add, delete, item-of). 4: Loops dynamically search/modify items. 5: Formats inventory or high-score systems.",
    "math": "1: Hardcoded numbers only. 2: Simple math errors or order confusion. 3: Calculates dynamic speed, offsets, scores. 4: Fluent mod, rounding, mult, div. 5: Physics or scaling models.",
    "messaging": "1: One sprite controls all; no broadcasts. 2: Single generic message for everything. 3: Named broadcasts with clear intent. 4: Descriptive, easy-to-trace architecture. 5: Protocol with no race conditions.",
    "algorithms": "1: Ad-hoc logic; works by coincidence. 2: Fails on edge cases or scale. 3: Step-by-step logic works for all inputs. 4: Efficient approach chosen with reason. 5: Optimized, documented design tradeoffs.",
    "nesting": "1: Flat code; no nested loops/conditionals. 2: Incorrect block scope nesting. 3: Functional nested loops or conditions. 4: Deliberate, clearly structured layers. 5: Builds state machines/complex systems.",
    "integration": "1: Isolated parts; non-functional project. 2: Features present but disconnected/broken. 3: Fully playable game (systems meet baseline). 4: Polished, seamless gameplay flow. 5: Flawless mastery of all systems combined.",
}

# The questions that stand for each dimension.
ASKED = {
    "problem_decomposition": [
        "Does the project show any explicit subproblems or separated components?",
        "Are subproblems described or commented anywhere?",
        "Are boundaries between parts clear?",
        "Are dependencies between parts explicitly shown?",
        "Is there a hierarchical structure (main -> subproblems)?",
        "Are subproblems named or documented?",
    ],
    "sequencing": [
        "Are steps placed in a logical order?",
        "Does any misordered block break intended behavior?",
        "Is there a clear start-to-finish flow?",
        "Are unnecessary steps avoided?",
        "Is the ordering optimized or deliberately chosen?",
    ],
    "loops": [
        "Are loops used instead of duplicated blocks?",
        "Are repeat counts correct?",
        "Are termination conditions correct?",
        "Are loops nested?",
        "Are loop types chosen appropriately (repeat vs repeat-until)?",
        "Are edge cases handled (0 iterations, 1 iteration)?",
    ],
    "conditionals": [
        "Are if/else blocks used?",
        "Are boolean conditions correct?",
        "Are compound conditions (AND/OR) used?",
        "Are redundant checks avoided?",
        "Are multi-branch states handled?",
        "Is conditional logic clean and non-duplicated?",
    ],
    "variables": [
        "Are variables used at all?",
        "Are variables initialized correctly?",
        "Are variable names descriptive?",
        "Are multiple game states tracked?",
        "Are variables updated in response to events?",
        "Is there a coherent variable system?",
    ],
    "event_handling": [
        "Are events beyond green flag used?",
        "Are multiple event types handled (key, click, broadcast)?",
        "Are handlers attached to correct sprites?",
        "Are event names descriptive?",
        "Do sprites react independently?",
        "Are event conflicts avoided?",
    ],
    "debugging": [
        "Are debugging comments present?",
        "Are variable values displayed for debugging?",
        "Is code isolated for testing?",
        "Are edge cases tested?",
        "Are subtle logic bugs addressed?",
        "Are fixes documented?",
    ],
    "procedures": [
        "Are custom blocks used?",
        "Do custom blocks have parameters?",
        "Are custom blocks reused?",
        "Do custom blocks reduce duplication?",
        "Are block names descriptive?",
        "Are complex behaviors abstracted?",
    ],
    "coordinates": [
        "Are x/y blocks used?",
        "Are positions updated dynamically?",
        "Are incremental movements used (change x/y)?",
        "Are boundaries checked?",
        "Are positions calculated mathematically?",
        "Are coordinate systems (grids, trajectories) designed?",
    ],
    "cloning": [
        "Are clones created?",
        "Do clones behave differently from originals?",
        "Are clones deleted when no longer needed?",
        "Are clone-specific variables initialized?",
        "Is clone quantity controlled?",
        "Are complex clone systems used (waves, particles)?",
    ],
    "collision": [
        "Are touching blocks used?",
        "Is collision checked inside loops?",
        "Are multiple collision types handled?",
        "Are collisions reliable every frame?",
        "Are collision outcomes distinct?",
        "Are timing/size issues handled?",
    ],
    "animation": [
        "Are costume changes used?",
        "Is animation timing correct?",
        "Do animations loop smoothly?",
        "Are animations tied to game events?",
        "Are multiple animation states used?",
        "Are transitions between states smooth?",
    ],
    "sound": [
        "Are sounds used?",
        "Are sounds triggered by events?",
        "Is timing correct (no overlap)?",
        "Is background music separated from SFX?",
        "Are start-sound vs play-until-done used correctly?",
        "Is there a layered sound system?",
    ],
    "ui_feedback": [
        "Is score/lives/timer shown?",
        "Does UI update in real time?",
        "Is UI clear and readable?",
        "Are start/end screens present?",
        "Are feedback messages used?",
        "Is UI polished and consistent?",
    ],
    "lists": [
        "Are lists used?",
        "Are list items accessed dynamically?",
        "Are list operations used (add/delete/item-of)?",
        "Are lists processed with loops?",
        "Are lists updated during gameplay?",
        "Are list-based systems designed (inventory, high scores)?",
    ],
    "math": [
        "Are arithmetic operators used?",
        "Are dynamic values computed?",
        "Are advanced operators used (multiply/divide/modulo)?",
        "Are operators chosen correctly?",
        "Are mathematical models used (scaling, physics)?",
        "Are random distributions or formulas used?",
    ],
    "messaging": [
        "Are broadcasts used?",
        "Are messages distinctly named?",
        "Do sprites respond correctly?",
        "Are multi-sprite interactions coordinated?",
        "Is messaging architecture clear?",
        "Are circular dependencies avoided?",
    ],
    "algorithms": [
        "Is there a step-by-step strategy?",
        "Does the algorithm work for all expected inputs?",
        "Are edge cases handled?",
        "Is efficiency considered?",
        "Are alternative approaches evaluated?",
        "Are algorithms documented?",
    ],
    "nesting": [
        "Are loops nested?",
        "Are conditionals nested?",
        "Is nesting correct (no scope errors)?",
        "Does nesting serve a clear purpose?",
        "Are nested structures documented?",
        "Are nested systems used (state machines, patterns)?",
    ],
    "integration": [
        "Do major systems (movement, collision, scoring, UI) work together?",
        "Is the project fully playable?",
        "Are features consistent across sprites?",
        "Are skills integrated smoothly?",
        "Is the project polished?",
        "Does the whole system demonstrate mastery?",
    ],
}
