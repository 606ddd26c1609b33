"""Distractor sentences per topic with the rule their number follows.

Own wording: any table of (topic, template, rule) rows can replace it.
"""

# topic -> (number rule, sentence)
SENTENCES: dict[str, list[tuple[str, str]]] = {
    "agriculture": [
        ("smaller", "Two crows pecked at {N} of the {object} at dawn."),
        ("smaller", "Mud still clings to {N} of the {object}."),
        ("smaller", "A neighbour admired {N} of the {object}."),
        ("any", "The barn behind the orchard is {N} years old."),
        ("any", "A scarecrow stands {N} steps from the gate."),
        ("any", "The cook keeps {N} old recipes in a drawer."),
        ("any", "Last season the fence had {N} loose boards."),
        ("percentage", "The soil is {N} percent clay."),
        ("any", "A tractor nearby carries the number {N}."),
        ("any", "The kitchen window looks out on {N} bean rows."),
    ],
    "commerce": [
        ("smaller", "Exactly {N} of the {object} wear a blue label."),
        ("smaller", "A clerk dusted {N} of the {object} at noon."),
        ("percentage", "The shop opposite is {N} percent larger."),
        ("percentage", "A poster speaks of {N} percent more joy."),
        ("any", "The counter has {N} drawers."),
        ("any", "The owner once worked in {N} other towns."),
        ("any", "The receipt printer is model {N}."),
        ("any", "There are {N} lamps above the till."),
        ("any", "A loyalty card shows {N} stars on its back."),
        ("any", "The front door has a bell that is {N} years old."),
    ],
    "inventory": [
        ("smaller", "Only {N} of the {object} face the window."),
        ("smaller", "A cousin once held {N} of the {object}."),
        ("smaller", "Among them {N} of the {object} smell of cedar."),
        ("any", "The shelf stands {N} inches from the floor."),
        ("any", "The room has {N} paintings of ships."),
        ("any", "An old catalogue lists them on page {N}."),
        ("any", "The cupboard key bears the number {N}."),
        ("any", "A museum shows {N} similar {object}."),
        ("percentage", "The display light is dimmed to {N} percent."),
        ("any", "The attic stairs count {N} steps."),
    ],
    "travel": [
        ("any", "A goat watched {N} trucks climb the pass."),
        ("any", "The radio plays song number {N}."),
        ("any", "A bridge on the way is {N} years old."),
        ("any", "The seat covers came in {N} colours."),
        ("any", "A map of the region has {N} folds."),
        ("any", "The station clock has {N} ornaments."),
        ("time", "A ferry nearby leaves at {N} o'clock."),
        ("any", "Another driver wears badge {N}."),
        ("percentage", "The tank gauge once read {N} percent too high."),
        ("any", "The hotel at the end has {N} windows."),
    ],
    "time": [
        ("time", "The tower bell was cast at {N} o'clock."),
        ("any", "The hourglass in the hall holds {N} spoons of sand."),
        ("any", "A diary on the desk has {N} blank pages."),
        ("any", "The alarm knows {N} melodies."),
        ("any", "Somebody across the street owns {N} watches."),
        ("any", "The planner was printed in batch {N}."),
        ("any", "A poem about seasons has {N} lines."),
        ("any", "The waiting room seats {N} people."),
        ("any", "The office plant is {N} inches tall."),
        ("percentage", "The screen brightness is set to {N} percent."),
    ],
    "nature": [
        ("smaller", "A ranger photographed {N} of the {object}."),
        ("any", "The nearest hill has {N} marked trails."),
        ("any", "A lighthouse there was painted {N} times."),
        ("any", "A guidebook names {N} kinds of moss."),
        ("any", "The visitor hut sells {N} different postcards."),
        ("any", "A weather vane on the hut is {N} years old."),
        ("any", "An old boat carries the number {N}."),
        ("any", "The bay has {N} names in local tales."),
    ],
    "education": [
        ("smaller", "The corridor wall shows {N} of the {object}."),
        ("any", "The school motto has {N} letters."),
        ("any", "The library ladder has {N} rungs."),
        ("any", "The caretaker keeps {N} keys on a ring."),
        ("any", "A portrait in the hall is number {N}."),
        ("any", "The choir knows {N} songs."),
        ("any", "The chalkboard was built in room {N}."),
        ("any", "The gym has {N} climbing ropes."),
    ],
    "construction": [
        ("smaller", "The painter liked {N} of the {object} best."),
        ("smaller", "Dust settled on {N} of the {object}."),
        ("any", "The crew wears {N} shades of orange."),
        ("any", "The toolbox holds {N} pencils."),
        ("any", "The site office has {N} chairs."),
        ("any", "The plan was drawn on sheet {N}."),
        ("any", "A crane nearby carries the number {N}."),
        ("any", "The fence shows {N} posters."),
    ],
    "general": [
        ("smaller", "Yesterday someone photographed {N} of the {object}."),
        ("any", "There are {N} clouds in a picture on the wall."),
        ("any", "A neighbour has lived there for {N} years."),
        ("any", "The street number is {N}."),
        ("any", "The radio host told {N} jokes."),
        ("any", "A sticker on the door shows the number {N}."),
        ("any", "The hallway has {N} hooks."),
        ("any", "The newspaper has {N} pages today."),
    ],
}
